"""Steps that run by the clock: recovery, retention, schedulers, samples and snapshots.

A stream of ticks (``now_ms``) drives them. Each step has an interval and runs at the
first tick that is that far behind its last run; missed runs are not made up for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How often each step runs, in ms.
INTERVALS_MS = {"recovery": 5_000, "retention": 60_000, "scheduler": 1_000, "sampler": 5_000, "snapshot": 120_000}


def due_steps(last: dict[str, int], now_ms: int, intervals: dict[str, int] = INTERVALS_MS) -> list[str]:
    """Steps that are due, in the order of the table; one that never ran is."""
    return [s for s, every in intervals.items() if s not in last or now_ms - last[s] >= every]


def run(ticks: DataFrame, steps: dict[str, Callable[[int], None]], checkpoint: str, intervals: dict[str, int] = INTERVALS_MS) -> dict[str, int]:
    """Drain a stream of ticks; gives the time of each step's last run.

    A micro-batch counts as its latest tick. A step that raises stops the stream, and
    its micro-batch runs again with the next start, so steps must bear repetition.
    """
    last: dict[str, int] = {}

    def step(batch: DataFrame, _epoch: int) -> None:
        now = batch.agg(F.max("now_ms")).first()[0]
        for name in due_steps(last, now, {s: intervals[s] for s in steps}) if now is not None else ():
            steps[name](now)
            last[name] = now

    ticks.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(step).start().awaitTermination()
    return last
