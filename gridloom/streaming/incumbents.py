"""Streaming forms of the incumbent operators: keyed state that grows with the keys, not with the events.

Defined results. Events without a task, a time or a finite cost do not count, nor do other types. At one time event_id decides.
Events that a stream brings later than its watermark allows count as if they had come when they did. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_best(events: DataFrame) -> DataFrame:
    """Incumbent events that are cheaper than every one before them in their task, numbered, as they arrive.

    events: task_id, event_id, type, cost_cents. In a micro-batch a task's events count in the order of event_id."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, sequence = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for event_id, cost in zip(rows.event_id, rows.cost_cents, strict=True):
            if best is None or cost < best:
                best, sequence = int(cost), sequence + 1
                out.append((key[0], int(event_id), best, sequence))
        if best is not None:
            state.update((best, sequence))
        yield pd.DataFrame(out, columns=["task_id", "event_id", "cost_cents", "sequence"])

    kept = events.where("type = 'incumbent'").select("task_id", "event_id", "cost_cents")
    out, held = "task_id long, event_id long, cost_cents long, sequence int", "best long, sequence int"
    return kept.groupBy("task_id").applyInPandasWithState(run, out, held, "append", GroupStateTimeout.NoTimeout)


#: A cost is better than another one by more than this part of the larger of them and 1.
TOLERANCE = 1e-9
NO_EVENT = -(2**63)
_EMITTED = "task_id long, event_id long, cost double, sequence int, emitted_us long"


@dataclass
class _Throttle:
    """What is known of one task: its best cost, how many improvements there were, when one was last told, and the one that waits."""

    best: float | None = None
    sequence: int = 0
    last: int | None = None
    waiting: int | None = None

    def due(self, now: int | None, interval: int) -> list[tuple[int, float, int, int]]:
        """The waiting improvement, if its time is before now."""
        if self.waiting is None or (now is not None and self.last + interval >= now):
            return []
        out = [(self.waiting, self.best, self.sequence, self.last + interval)]
        self.last, self.waiting = self.last + interval, None
        return out

    def feed(self, event_id: int, at: int, cost: float, interval: int) -> list[tuple[int, float, int, int]]:
        """What is told at or before the time of an incumbent."""
        out = self.due(at, interval)
        if self.best is not None and cost >= self.best - TOLERANCE * max(1.0, abs(cost), abs(self.best)):
            return out
        self.best, self.sequence = cost, self.sequence + 1
        if self.last is None or at >= self.last + interval:
            self.last, self.waiting = at, None
            return [*out, (event_id, cost, self.sequence, at)]
        self.waiting = event_id
        return out


def _incumbents(events: DataFrame) -> DataFrame:
    """task_id, event_id, ts, us, cost of the events that count."""
    fine = "type = 'incumbent' and task_id is not null and ts is not null and cost is not null and not isnan(cost) and abs(cost) < double('infinity')"
    return events.where(fine).select(F.col("task_id").cast("long").alias("task_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("cost").cast("double").alias("cost"))


def _shown(told: DataFrame) -> DataFrame:
    return told.select("task_id", "event_id", "cost", "sequence", F.timestamp_micros("emitted_us").alias("emitted_at"))


def emitted(events: DataFrame, interval_ms: int) -> DataFrame:
    """What is told of the improvements of each task: task_id, event_id, cost, sequence (of all improvements), emitted_at.

    events: task_id, event_id, type, ts, cost. The first improvement is told at once, a later one at once if an interval has
    passed since the last one told, else when it has, if no better one comes before. Tasks are sorted within partitions and
    folded as they pass, so memory does not follow the length of a task."""
    interval = interval_ms * 1000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, state = None, _Throttle()
        for rows in batches:
            out = []
            for t, event_id, us, cost in zip(rows.task_id.tolist(), rows.event_id.tolist(), rows.us.tolist(), rows.cost.tolist(), strict=True):
                if t != task:
                    out += [(task, *e) for e in state.due(None, interval)]
                    task, state = t, _Throttle()
                out += [(t, *e) for e in state.feed(event_id, us, cost, interval)]
            yield pd.DataFrame(out, columns=["task_id", "event_id", "cost", "sequence", "emitted_us"])
        yield pd.DataFrame([(task, *e) for e in state.due(None, interval)], columns=["task_id", "event_id", "cost", "sequence", "emitted_us"])

    dealt = _incumbents(events).drop("ts").repartition("task_id").sortWithinPartitions("task_id", "us", "event_id")
    return _shown(dealt.mapInPandas(run, _EMITTED))


def emitted_stream(events: DataFrame, interval_ms: int, delay: str = "0 seconds") -> DataFrame:
    """emitted() of a stream: a waiting improvement is told once the watermark, delay behind the newest event, passes its time."""
    interval = interval_ms * 1000

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, out = _Throttle(*held.get) if held.exists else _Throttle(), []
        state.waiting = None if state.waiting == NO_EVENT else state.waiting
        now = held.getCurrentWatermarkMs() * 1000
        if held.hasTimedOut:
            out = state.due(now, interval)
        else:
            rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
            for event_id, us, cost in zip(rows.event_id.tolist(), rows.us.tolist(), rows.cost.tolist(), strict=True):
                out += state.feed(event_id, us, cost, interval)
            out += state.due(now, interval)
        held.update(astuple(_Throttle(state.best, state.sequence, state.last, NO_EVENT if state.waiting is None else state.waiting)))
        if state.waiting is not None:
            held.setTimeoutTimestamp(max((state.last + interval) // 1000, held.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([(key[0], *e) for e in out], columns=["task_id", "event_id", "cost", "sequence", "emitted_us"])

    kept = _incumbents(events).withWatermark("ts", delay)
    return _shown(kept.groupBy("task_id").applyInPandasWithState(run, _EMITTED, "best double, sequence int, last long, waiting long", "append", GroupStateTimeout.EventTimeTimeout))
