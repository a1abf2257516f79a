"""Streaming forms of the stateful gates.

Within a micro-batch rows are taken in the order (t_ms, seq); between batches the
state of each key is in Spark's state store, checkpointed with the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobloom.operators.limits import SlidingBucket


def sliding_admission(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """``admitted`` for a stream of (seq, t_ms, facet), by the sliding-window counter."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = SlidingBucket(*state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t_ms", "seq"])
        admitted = []
        for now in rows["t_ms"]:
            ok, bucket = SlidingBucket.admit(bucket, int(now), window_ms, limit)
            admitted.append(ok)
        if bucket is not None:
            state.update((bucket.start, bucket.current, bucket.previous))
        yield pd.DataFrame({"seq": rows["seq"], "facet": key[0], "admitted": admitted})

    return requests.groupBy("facet").applyInPandasWithState(step, "seq long, facet string, admitted boolean", "start long, current long, previous long", "append", GroupStateTimeout.NoTimeout)


def fixed_window_admission(claims: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """``admitted`` for a stream of (seq, t_ms, facet), by a window that opens with its first claim."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, expires = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["t_ms", "seq"])
        admitted = []
        for now in map(int, rows["t_ms"]):
            ok = limit > 0 and not (expires > now and count >= limit)
            if ok:
                count, expires = (count + 1, expires) if expires > now else (1, now + window_ms)
            admitted.append(ok)
        state.update((count, expires))
        yield pd.DataFrame({"seq": rows["seq"], "facet": key[0], "admitted": admitted})

    return claims.groupBy("facet").applyInPandasWithState(step, "seq long, facet string, admitted boolean", "count long, expires long", "append", GroupStateTimeout.NoTimeout)


def dedup_receipts(requests: DataFrame) -> DataFrame:
    """``outcome`` and ``first_seq`` for a stream of (seq, t_ms, name, idempotency_key, request)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t_ms", "seq"])
        stored = state.get if state.exists else None
        outcomes = []
        for seq, request in zip(rows["seq"], rows["request"]):
            if stored is None:
                stored = (int(seq), request)
                outcomes.append("new")
            else:
                outcomes.append("replay" if request == stored[1] else "conflict")
        state.update(stored)
        yield pd.DataFrame({"seq": rows["seq"], "outcome": outcomes, "first_seq": stored[0]})

    return requests.groupBy("name", "idempotency_key").applyInPandasWithState(step, "seq long, outcome string, first_seq long", "first_seq long, request string", "append", GroupStateTimeout.NoTimeout)


def chain_quarantine(requests: DataFrame, cap: int) -> DataFrame:
    """``within_quota`` for a stream of (seq, t_ms, trace_id)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t_ms", "seq"])
        had = state.get[0] if state.exists else 0
        yield pd.DataFrame({"seq": rows["seq"], "within_quota": [had + i < cap for i in range(len(rows))]})
        state.update((min(cap, had + len(rows)),))

    return requests.groupBy("trace_id").applyInPandasWithState(step, "seq long, within_quota boolean", "jobs long", "append", GroupStateTimeout.NoTimeout)
