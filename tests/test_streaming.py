import datetime as dt
import random

import pytest

from gridloom.operators import state
from gridloom.plans import fixtures as fx
from gridloom.streaming import incumbents


def test_stream_gives_the_batch_rows(spark, tmp_path):
    events = fx.view(spark, "/root/testdata/sf0.001", fx.SOLVER_EVENTS).select("task_id", "event_id", "type", "cost_cents")
    for k, part in enumerate([events.where("event_id < 300"), events.where("event_id between 300 and 650"), events.where("event_id > 650")]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = incumbents.running_best(stream).writeStream.format("memory").queryName("best").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted(map(tuple, spark.sql("select task_id, event_id, cost_cents, sequence from best").collect()))
    assert got == sorted(map(tuple, state.running_best(events).collect()))


def plainly(rows, interval):
    """Told improvements of one task, by stepping a clock from millisecond to millisecond."""
    best, last, wait, n, out = None, None, None, 0, []
    for now in range(0, 2000):
        for event_id, at, cost in sorted(rows, key=lambda r: (r[1], r[0])):
            if at == now and (best is None or cost < best - 1e-9 * max(1, abs(cost), abs(best))):
                best, n = cost, n + 1
                wait = (event_id, cost, n)
                if last is None or now >= last + interval:
                    out.append((*wait, now))
                    last, wait = now, None
        if wait and now >= last + interval:
            out.append((*wait, now))
            last, wait = now, None
    return out


@pytest.mark.parametrize("cuts", [[], [300], [100, 101, 420, 700]])
def test_told_improvements_whatever_the_batches(spark, tmp_path, cuts):
    rng, start = random.Random(5), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(t, 1000 * t + k, "incumbent", at, round(1e6 / (k + 1) + rng.choice((0.0, 1e-7, 4e5)), 7)) for t in range(6) for k, at in enumerate(sorted(rng.sample(range(900), 40)))]
    want = sorted((t, *r) for t in range(6) for r in plainly([(r[1], r[3], r[4]) for r in rows if r[0] == t], 70))
    assert len(want) > 40
    rows += [(1, 5, "heartbeat", 3, 0.0), (None, 6, "incumbent", 4, 0.0), (2, 7, "incumbent", None, 0.0), (2, 8, "incumbent", 5, float("nan")), (2, 9, "incumbent", 5, None), (99, 1, "incumbent", 5000, 1.0)]
    timed = [(t, e, y, None if at is None else start + dt.timedelta(milliseconds=at), c) for t, e, y, at, c in rows]
    events = spark.createDataFrame(timed, "task_id long, event_id long, type string, ts timestamp, cost double")
    told = lambda df: sorted((r.task_id, r.event_id, r.cost, r.sequence, round((r.emitted_at.astimezone(dt.timezone.utc) - start).total_seconds() * 1000)) for r in df.collect() if r.task_id != 99)
    assert told(incumbents.emitted(events, 70)) == want
    assert incumbents.emitted(events.limit(0), 70).count() == 0
    ends = [-1, *cuts, 10_000]
    for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        part = [r for r in timed if (0 if r[3] is None else round((r[3] - start).total_seconds() * 1000)) > a and (0 if r[3] is None else round((r[3] - start).total_seconds() * 1000)) <= b]
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    name = f"told{len(cuts)}"
    q = incumbents.emitted_stream(stream, 70).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert told(spark.table(name)) == want
