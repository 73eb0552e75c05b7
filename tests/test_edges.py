"""What boxes at the sides of the field miss, against a plain loop; names of problems."""

import random

from gridloom.operators import layout, model

BOX = "plan_id long, poly_id long, x0 long, y0 long, x1 long, y1 long, low string"


def plainly(boxes, needs, zones, low, high, exact):
    out = {}
    for b in boxes:
        layers = needs.get(b[1])
        if not layers or (b[2] > low and b[4] < high):
            continue
        for t in set(layers):
            need = sum(c >= t for c in layers)
            miss = sorted(max(0, z[2] - b[2], b[4] - z[4]) for z in zones if (z[6] == t if exact else z[6] >= t) and z[3] <= b[3] and z[5] >= b[5])
            covered = sum(m == 0 for m in miss)
            enough = len(miss) >= need
            out[b[1], t] = (need, covered, float(miss[need - 1]) if enough else None, 0.0 if covered >= need else float(sum(miss[:need])) if enough else 1e9)
    return out


def test_random_plans(spark):
    rng, boxes, needs, zones, fields = random.Random(11), [], [], [], []
    for p in range(12):
        side = lambda: sorted(rng.sample(range(9), 2))
        for k in range(10):
            (x0, x1), (y0, y1) = side(), side()
            boxes.append((p, k, x0, y0, x1, y1, "clash"))
            needs.append((p, k, [rng.randint(1, 3) for _ in range(rng.randint(0, 3))] if k else None))
            (x0, x1), (y0, y1) = side(), side()
            zones.append((p, k, x0, min(y0, 2), x1, y1, rng.randint(1, 3)))
        fields.append((p, 0, 8))
    frames = spark.createDataFrame(boxes, BOX), spark.createDataFrame(needs, "plan_id long, poly_id long, layers array<int>"), spark.createDataFrame(zones, "plan_id long, zone_id long, x0 long, y0 long, x1 long, y1 long, cls int")
    for exact in (False, True):
        got = layout.edge_misses(*frames, spark.createDataFrame(fields[1:], "plan_id long, low long, high long"), exact=exact)
        rows = {p: {} for p, *_ in fields}
        for r in got.collect():
            rows[r.plan_id][r.poly_id, r.threshold] = (r.need, r.covered, r.best_miss, r.miss_sum)
        want = {p: plainly(*([r for r in t if r[0] == p] if t is not needs else {r[1]: r[2] for r in t if r[0] == p} for t in (boxes, needs, zones)), 0, 8, exact) for p, *_ in fields}
        assert rows[0] == {} and all(rows[p] == want[p] for p in range(1, 12))
        score = {r.plan_id: (r.lacking, r.missed) for r in layout.edge_score(got).collect()}
        assert score == {p: (sum(max(0, n - c) for n, c, _, _ in w.values()), sum(m for *_, m in w.values())) for p, w in want.items() if p and w}
        assert layout.edge_relaxations(got).count() == sum(n > c for p, w in want.items() if p for n, c, _, _ in w.values())


def test_names_of_problems(spark):
    def named(order, hold=32.0, cls=2, plan=1, axis="y"):
        df = lambda rows, schema: spark.createDataFrame(sorted(rows, reverse=order), schema)
        edges = df([(plan, 0, 0, 10), (plan, 1, 10, 25)], "plan_id long, i long, lo long, hi long")
        got = model.problem_ids(
            df([(plan, 0, 0, 1), (plan, 0, 1, cls)], "plan_id long, iy long, ix long, cls int"), edges, edges, df([(plan, 0, 0, 1, 1, 1), (plan, 0, 0, 0, 0, 2)], "plan_id long, x0 long, y0 long, x1 long, y1 long, cls int"),
            df([(plan, 1, 5.5), (plan, 2, 7.25)], "plan_id long, cls int, density double"), df([(plan, 1, hold), (plan, 2, 40.0)], "plan_id long, cls int, hold double"), df([(plan, 1, [1]), (plan, 2, [2, 1] if order else [1, 2])], "plan_id long, cls int, layers array<int>"), axis,
        )
        return got.first().problem_id

    first = named(False)
    assert named(True) == first == named(False, plan=9)
    assert len({first, named(False, hold=32.5), named(False, cls=3), named(False, axis="x"), named(False, axis=None)}) == 5
