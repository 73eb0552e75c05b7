"""Scores, descent and mended contacts against plain loops and every choice."""

import itertools
import math
import random

import numpy as np

from gridloom.kernels.choose import Plan, choose, mend


def made(rnd):
    n = rnd.randint(1, 5)
    zones = []
    for _ in range(n):
        c = rnd.choice([1, 2, 3])
        x, y = rnd.randrange(0, 16, 2), rnd.randrange(6)
        zones.append((c, {1: 6, 2: 4, 3: 2}[c], rnd.choice([0, 1, 2]), (x, y, x + rnd.choice([4, 6, 12]), y + rnd.randint(1, 5))))
    served = [{b: (b, b + 3) for b in rnd.sample(range(20), rnd.randint(0, 3))} for _ in zones]
    options = [np.array(sorted({(float(x), float(x + z[1] * k)) for x in rnd.sample(range(24), 4) for k in (1, 2)})) for z in zones]
    contacts = [(a, b) for a, b in itertools.permutations(range(n), 2) if zones[a][0] == zones[b][0] and rnd.random() < 0.4]
    return zones, served, options, contacts


def plan_of(zones, served, contacts):
    old = np.array([z[3] for z in zones], float)
    return Plan(old, old[:, 1::2].copy(), np.array([z[0] for z in zones]), np.array([z[1] for z in zones], float), np.array([z[2] for z in zones]), served, contacts, (0.0, 23.0), 2.0, np.zeros((len(zones), 2)))


def plain_score(zones, served, contacts, x, i):
    pos = [[a + k * z[1] for k in range(round((b - a) / z[1]) + 1)] for (a, b), z in zip(x, zones, strict=True)]
    c, step, stage, old = zones[i]
    a, b = x[i]
    out = dict.fromkeys(("over", "area", "triple", "close", "lack", "edge", "miss", "inner", "extra", "contact", "far", "phase", "off"), 0)
    both = lambda p, q, r, s: min(q, s) - max(p, r)
    beside = lambda j, k: both(zones[j][3][1], zones[j][3][3], zones[k][3][1], zones[k][3][3]) > 0
    others = [j for j in range(len(zones)) if j != i and zones[j][2] <= stage]
    for low, high in served[i].values():
        miss = max(0, a - low, high - b)
        if low <= 0 or high >= 23:
            out["edge"], out["miss"] = out["edge"] + (miss > 0), out["miss"] + miss
        else:
            extra = max(0, miss - step)
            out["inner"], out["extra"] = out["inner"] + (extra > 0), out["extra"] + extra
    for j in others:
        o, w = zones[j][3], both(a, b, *x[j])
        apart = both(old[0], old[2], o[0], o[2]) <= 0 or both(old[1], old[3], o[1], o[3]) <= 0
        if zones[j][0] == c and apart and w > 0 and beside(i, j):
            out["over"], out["area"] = out["over"] + 1, out["area"] + w * both(old[1], old[3], o[1], o[3])
        if w > 0 and beside(i, j):
            ds = [abs(p - q) for p in pos[i] for q in pos[j] if all(max(a, x[j][0]) <= v <= min(b, x[j][1]) for v in (p, q)) and p != q]
            if ds and min(ds) < 2:
                out["close"], out["lack"] = out["close"] + 1, out["lack"] + 2 - min(ds)
            if set(served[i]) & set(served[j]):
                g, module = math.gcd(step, zones[j][1]), math.lcm(*(z[1] for z in zones))
                big, small = max(step, zones[j][1]), min(step, zones[j][1])
                want = (big / 2 if big == module else 0) if big == small else ((big / 3 if small / 3 >= 2 else small / 2) if big == 2 * small else 0) if big % small == 0 else (g / 2 if g >= 4 else 0)
                z = (a - x[j][0]) % g
                e = min(min((z - v) % g, g - (z - v) % g) for v in (want, -want))
                if e > 1e-8:
                    out["phase"], out["off"] = out["phase"] + 1, out["off"] + e
    for j, k in itertools.combinations(others, 2):
        if beside(i, j) and beside(i, k) and beside(j, k):
            low, high = max(x[z][0] for z in (i, j, k)), min(x[z][1] for z in (i, j, k))
            out["triple"] += sum(low <= p <= high for p in set(pos[i]) & set(pos[j]) & set(pos[k]))
    for p, q in contacts:
        if i in (p, q) and zones[p][2] <= stage and zones[q][2] <= stage:
            z = x[q][0] - x[p][1]
            if z < 0:
                out["contact"], out["far"] = out["contact"] + 1000, out["far"] - z
            elif z != zones[p][1]:
                out["contact"], out["far"] = out["contact"] + 1, out["far"] + abs(z - zones[p][1])
    return (*out.values(), (b - a) * (old[3] - old[1]), abs(a - old[0]) + abs(b - old[2]))


def test_scores_and_descent_against_plain_loops():
    rnd = random.Random(8)
    seen = np.zeros(15)
    for _ in range(150):
        zones, served, options, contacts = made(rnd)
        plan = plan_of(zones, served, contacts)
        for _ in range(3):
            plan.x = np.array([rnd.choice(o.tolist()) for o in options])
            for i in range(len(zones)):
                want = plain_score(zones, served, contacts, plan.x.tolist(), i)
                assert np.allclose(plan.score(i, *plan.x[i]), want)
                seen += np.array(want) > 0
        choose(plan, options, 3)
        x = [min(o.tolist(), key=lambda r: (r[1] - r[0], abs(r[0] - z[3][0]) + abs(r[1] - z[3][2]))) for o, z in zip(options, zones, strict=True)]
        for stage in sorted({z[2] for z in zones}):
            mine = [i for i, z in enumerate(zones) if z[2] == stage]
            for turn in range(3):
                before = [list(v) for v in x]
                for i in mine if turn % 2 == 0 else mine[::-1]:
                    def key(r, i=i):
                        return plain_score(zones, served, contacts, [*x[:i], r, *x[i + 1 :]], i)
                    x[i] = min([x[i], *options[i].tolist()], key=key)
                if x == before:
                    break
        assert np.allclose(plan.x, x)
        for i in range(len(zones)):
            assert np.allclose(plan.score(i, *plan.x[i]), plain_score(zones, served, contacts, x, i))
    assert (seen > 0).all(), seen


def test_mended_contacts_against_every_choice():
    rnd, changed = random.Random(9), 0
    for _ in range(200):
        zones, served, options, _ = made(rnd)
        n = len(zones)
        contacts = [(k, k + 1) for k in range(n - 1) if rnd.random() < 0.7]
        plan = plan_of(zones, served, contacts)
        choose(plan, options, 1)
        before, faults = plan.x.copy(), plan.faults()
        mend(plan, options)
        near = {k for c in contacts for k in c}
        gap = lambda x: all(x[b][0] - x[a][1] == min(zones[a][1], zones[b][1]) for a, b in contacts)  # noqa: B023, E731
        if gap(plan.x) and contacts:
            changed += not np.array_equal(before, plan.x)
            every = [options[k].tolist() if k in near else [before[k].tolist()] for k in range(n)]
            least = min(np.abs(np.array(x) - before).sum() for x in itertools.product(*every) if gap(x))
            assert np.abs(plan.x - before).sum() <= least + 1e-9
        assert plan.faults() <= faults
        for k in set(range(n)) - near:
            assert (plan.x[k] == before[k]).all()
    assert changed > 5
