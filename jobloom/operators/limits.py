"""Windowed controls: a sliding-window counter and an anchored fixed window.

Both are sequential by nature: whether one request is admitted depends on which
ones before it were. They run as one fold per facet; a facet's requests stream
through it in order, batch by batch, so memory doesn't grow with a facet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Narrow rows that may be broadcast.
BROADCAST_ROWS = 100_000


@dataclass
class SlidingBucket:
    """A two-bucket sliding-window counter."""

    start: int
    current: int = 0
    previous: int = 0

    def rolled(self, now: int, window: int) -> SlidingBucket:
        elapsed = now - self.start
        steps = elapsed // window if elapsed >= 0 else 0
        if steps == 0:
            return self
        if steps == 1:
            return SlidingBucket(self.start + window, 0, self.current)
        return SlidingBucket(now - elapsed % window, 0, 0)

    def estimate(self, now: int, window: int) -> float:
        weight = min(1.0, max(0.0, (window - (now - self.start)) / window))
        return self.previous * weight + self.current

    @staticmethod
    def admit(bucket: SlidingBucket | None, now: int, window: int, limit: int) -> tuple[bool, SlidingBucket | None]:
        """Admission of one request; a refusal leaves the stored bucket as it was."""
        if limit <= 0:
            return False, bucket
        rolled = bucket.rolled(now, window) if bucket else SlidingBucket(now)
        if rolled.estimate(now, window) >= limit:
            return False, bucket
        return True, SlidingBucket(rolled.start, rolled.current + 1, rolled.previous)


def _fold(requests: DataFrame, facet: str, order: list[str], reads: list[str], step, out: str, kind: str) -> DataFrame:
    """Add ``out`` by a fold over each facet's rows in order; state is kept from batch to batch.

    ``step`` gets the row's ``reads`` and the facet's state, and gives a value and the next state.
    Rows without a facet match no rule: they are admitted, and spread over all tasks.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in requests.schema)}, `{out}` {kind}"
    columns = [f.name for f in requests.schema] + [out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            values = []
            for k, *row in zip(pdf[facet].tolist(), *(pdf[c].tolist() for c in reads)):
                if k is None:
                    values.append(True)
                    continue
                if k != key:
                    key, state = k, None  # rows are sorted: a new facet ends the one before
                value, state = step(row, state)
                values.append(value)
            yield pdf.assign(**{out: values})[columns]

    home = F.coalesce(F.col(facet).cast("string"), F.col(order[-1]).cast("string"))
    ordered = requests.repartition(home).sortWithinPartitions(facet, *order)
    return ordered.mapInPandas(run, schema)


def sliding_admission(requests: DataFrame, limit: int | None = None, window_ms: int | None = None, facet: str = "facet", time: str = "t_ms", seq: str = "seq", counts: str | None = None) -> DataFrame:
    """``admitted`` for each request, by the sliding-window counter of its facet.

    Limit and window are the same for all facets, or columns ``max_jobs`` and
    ``window_duration_ms`` (null: no rule, always admitted). A null facet matches no rule.
    With ``counts``, a boolean column, other rows are passed over and use no quota.
    """
    fixed = limit is not None

    def step(row: list, bucket: SlidingBucket | None):
        if counts and not row.pop():
            return True, bucket
        now, most, window = (row[0], limit, window_ms) if fixed else row
        if most is None or most != most:
            return True, bucket
        return SlidingBucket.admit(bucket, int(now), int(window), int(most))

    reads = [time] if fixed else [time, "max_jobs", "window_duration_ms"]
    return _fold(requests, facet, [time, seq], reads + [counts] * bool(counts), step, "admitted", "boolean")


def fixed_window_admission(claims: DataFrame, limit: int, window_ms: int, facet: str = "facet", time: str = "t_ms", seq: str = "seq") -> DataFrame:
    """``admitted`` by a window that opens with its first claim: [t, t + window)."""

    def step(row: list, state: tuple[int, int] | None):
        now = int(row[0])
        count, expires = state or (0, 0)
        if limit <= 0 or (expires > now and count >= limit):
            return False, state
        return True, (count + 1, expires) if expires > now else (1, now + window_ms)

    return _fold(claims, facet, [time, seq], [time], step, "admitted", "boolean")


def sliding_status(rules: DataFrame, counters: DataFrame, now_ms: int) -> DataFrame:
    """What the sliding counters show now, without changing them."""
    c = rules.join(counters, rules["facet_pattern"] == counters["facet_key"], "left")
    w, now = F.col("window_duration_ms"), F.lit(now_ms)
    elapsed = now - F.col("current_window_start")
    steps = F.when(elapsed >= 0, F.expr(f"({now_ms} - current_window_start) div window_duration_ms")).otherwise(0)
    start = F.when(steps == 0, F.col("current_window_start")).when(steps == 1, F.col("current_window_start") + w).otherwise(now - F.pmod(elapsed, w))
    current = F.when(steps == 0, F.col("current_count")).otherwise(0)
    previous = F.when(steps == 0, F.col("previous_count")).when(steps == 1, F.col("current_count")).otherwise(0)
    c = c.select("facet_pattern", "max_jobs", "window_duration_ms", start.alias("window_start"), current.alias("cur"), previous.alias("prev"))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (w - (now - F.col("window_start"))).cast("double") / w))
    estimate = F.coalesce(F.col("prev") * weight + F.col("cur"), F.lit(0.0))
    return c.select("facet_pattern", "max_jobs", "window_duration_ms", "window_start", F.round(estimate).cast("long").alias("estimated_count"), ((F.col("max_jobs") <= 0) | (estimate >= F.col("max_jobs"))).alias("throttled"))


def fixed_status(rules: DataFrame, counters: DataFrame, now_ms: int) -> DataFrame:
    """What the fixed windows show now; an expired window counts nothing."""
    c = rules.join(counters, rules["facet_pattern"] == counters["facet_key"], "left")
    live = F.coalesce(F.col("window_expires_at") > now_ms, F.lit(False))
    count = F.when(live, F.col("current_count")).otherwise(0).cast("long")
    return c.select("facet_pattern", "max_jobs", "window_duration_ms", count.alias("current_count"), F.when(live, F.col("window_expires_at")).alias("window_expires_at"), ((F.col("max_jobs") <= 0) | (count >= F.col("max_jobs"))).alias("throttled"))


def blocked(now_ms: int) -> Column:
    """Whether a rule joined with its counter blocks its facet."""
    return (F.col("max_jobs") <= 0) | F.coalesce((F.col("window_expires_at") > now_ms) & (F.col("current_count") >= F.col("max_jobs")), F.lit(False))


def blocked_facets(rules: DataFrame, counters: DataFrame, now_ms: int) -> DataFrame:
    c = rules.join(counters, rules["facet_pattern"] == counters["facet_key"], "left")
    return c.where(blocked(now_ms)).select(F.col("facet_pattern").alias("rate_limit_facet"))


def small(rows: DataFrame) -> DataFrame:
    """``rows`` to be broadcast if they are at most ``BROADCAST_ROWS``, as a look at them shows; others are joined as they come."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def valid_rule(facet: Column, window_ms: Column) -> Column:
    """An exact facet: not blank, no outer white space, no wildcard; and a window over 0."""
    return F.coalesce((F.trim(facet) != "") & (F.trim(facet) == facet) & ~facet.rlike("[*?]") & (window_ms > 0), F.lit(False))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Insert or update by key; columns in ``keep`` hold on to a stored value."""
    t, c = table.alias("t"), changes.alias("c")
    on = [F.col(f"t.{k}") == F.col(f"c.{k}") for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond &= x
    hit = F.col(f"c.{keys[0]}").isNotNull()
    cols = []
    for name in table.columns:
        old = F.col(f"t.{name}")
        new = F.col(f"c.{name}") if name in changes.columns else old
        cols.append((F.coalesce(old, new) if name in keep or name in keys else F.when(hit, new).otherwise(old)).alias(name))
    return t.join(c, cond, "full_outer").select(*cols)
