"""Exact top-k inner-product search by no-random-access aggregation (NRA).

Queries come in blocks of bounded size, each of which is sent to all tasks; candidates
stay where they are and are read in blocks. In a block every dimension is a list
sorted by its value. For a query the lists are read step by step, in equal depth, from
the end that the query's sign prefers. What has been read of a candidate gives bounds
for its score: unread values count as the last one read from their list (upper) or as
the list's other end (lower). The k-th best among the lower bounds and the scores
that earlier blocks have left is what a place needs; a candidate whose upper bound is
below it cannot qualify and is dropped, also from later reads. Reading stops as soon
as only contenders, a few times k, are left; their final scores are resolved from
their vectors. All values are integers, so bounds and scores are exact.

A task returns at most ``k`` rows a query, and a window ranks these. Where values are
so large that floats don't hold the scores, candidates are scored in full with whole
numbers of any size.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do rows without an id; only vectors of equal length
are compared; repeated candidate rows each count; a repeated query id is asked
once, with its smallest vector; ties go to the smaller id; scores beyond a long
are its largest or smallest value; ids are cast to long; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import map_arrow, stage

#: Queries that are sent to the tasks at once; candidates whose lists are read together.
QUERY_ROWS = 4096
BLOCK_ROWS = 8192
#: Values of such a block, so that long vectors make smaller ones; queries that take a step together.
BLOCK_VALUES = 1 << 20
TOGETHER = 64
#: Depths of the steps, as shares of the lists.
DEPTHS = (1 / 2, 3 / 4, 7 / 8, 15 / 16, 1)
#: Reading stops when so many times k candidates are left.
CONTENDERS = 4


def scaled(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of each component, for the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & whole)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) over a table of ``scaled`` vectors."""
    asked = vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    parts = max(1, -(-asked.count() // query_rows))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()  # about query_rows rows
        found = _against(vectors, own, k, block_rows)
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = stage(found, "topk") if parts > 1 else found  # one block of queries after another
        out = found if out is None else out.unionByName(found)
    return out


def _against(vectors: DataFrame, asked: list, k: int, block_rows: int) -> DataFrame:
    """The best ``k`` candidates of every task for each of some queries."""
    groups: dict[int, list] = {}
    for r in asked:
        groups.setdefault(len(r.v), []).append(r)
    queries = {d: (np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], np.int64)) for d, rows in groups.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(ids, v, k) for d, (ids, v) in shared.value.items()}
        held: dict[int, list] = {d: [] for d in best}
        for b in batches:
            ids, v = b.column(0).to_numpy(), b.column(1)
            first, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            size = np.diff(first)
            for d in set(size.tolist()) & best.keys():
                own = np.flatnonzero(size == d)
                held[d].append((ids[own], flat[first[own][:, None] + np.arange(d)]))
                if sum(len(x[0]) for x in held[d]) >= block_rows:
                    best[d].read(held.pop(d), block_rows)
                    held[d] = []
        for d, rest in held.items():
            best[d].read(rest, block_rows)
            yield best[d].table()

    return map_arrow(vectors.select("id", "v"), run, "query_id long, vec_id long, score long")


class Best:
    """The best candidates so far for each of some queries of one length."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int) -> None:
        self.ids, self.v, self.k = ids, v, k
        none = np.zeros(0, np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(none, none)] * len(ids)  # (vec_ids, scores), best first
        self.reads = self.resolved = 0  # list entries read, and candidates whose scores were resolved

    def read(self, parts: list[tuple[np.ndarray, np.ndarray]], block_rows: int) -> None:
        if not parts or not len(self.ids):
            return
        ids, v = (np.concatenate(x) for x in zip(*parts))
        block_rows = max(1, min(block_rows, BLOCK_VALUES // v.shape[1]))
        for lo in range(0, len(ids), block_rows):
            self._block(ids[lo : lo + block_rows], v[lo : lo + block_rows])

    def _block(self, ids: np.ndarray, v: np.ndarray) -> None:
        reach = float(np.abs(v.astype(float)).max(initial=0)) * float(np.abs(self.v.astype(float)).max(initial=0)) * v.shape[1]
        exact = reach < 2**52  # floats hold these integers and their sums
        if exact:
            had = np.full((len(self.ids), self.k), -np.inf)
            for i, (_, score) in enumerate(self.found):
                had[i, : len(score)] = score
            left_of = Lists(ids, v).contenders(self.ids, self.v, had, self.k)
        for i, one in enumerate(self.ids):
            had_ids, score = self.found[i]
            left, reads = left_of[i] if exact else (np.flatnonzero(ids != one), 0)
            kind = float if exact else object
            got = v[left].astype(kind) @ self.v[i].astype(kind)
            got = got.astype(np.int64) if exact else np.array([max(-(2**63), min(2**63 - 1, x)) for x in got], np.int64)
            self.reads += reads
            self.resolved += len(left)
            ids_, got = np.concatenate([had_ids, ids[left]]), np.concatenate([score, got])
            order = np.lexsort((ids_, -got if exact else -got.astype(object)))[: self.k]
            self.found[i] = ids_[order], got[order]

    def table(self) -> pa.RecordBatch:
        sizes = [len(f[0]) for f in self.found]
        join = lambda j: np.concatenate([np.zeros(0, np.int64), *(f[j] for f in self.found)])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.repeat(self.ids, sizes), join(0), join(1))], ["query_id", "vec_id", "score"])


class Lists:
    """Every dimension of a block of candidates as a sorted list."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.rows = ids, v.astype(float)
        self.order = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.rows, self.order, 0)

    def _known(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What reading to ``depth`` tells of each row, the most and the least: for lists read from their high ends, then from their low ends."""
        n, dims = self.rows.shape
        high, low = np.zeros((2, n, dims), bool)
        high[self.order[n - depth :], np.arange(dims)] = True
        low[self.order[:depth], np.arange(dims)] = True
        most = np.concatenate([np.maximum(self.rows, self.values[n - depth]), np.minimum(self.rows, self.values[depth - 1])], 1)
        least = np.concatenate([np.where(high, self.rows, self.values[0]), np.where(low, self.rows, self.values[-1])], 1)
        return np.ascontiguousarray(most.T), np.ascontiguousarray(least.T)

    def contenders(self, query_ids: np.ndarray, queries: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
        """Per query the candidates that may be among the ``k`` best, beside its ``scores`` found before (padded with -inf), and the entries read.

        Queries that prefer the same end of a list share its reading, so a step is
        taken for all that haven't stopped.
        """
        n = len(self.rows)
        few = CONTENDERS * k
        if n <= few:
            return [(np.flatnonzero(self.ids != one), 0) for one in query_ids]
        q = queries.astype(float)
        signed = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1)  # by the end they prefer
        lists = np.count_nonzero(q, 1)  # others add nothing
        out: list = [None] * len(q)
        pending, depth = np.arange(len(q)), 0
        for share in DEPTHS:
            depth = min(n, max(depth + 1, int(n * share)))
            most, least = self._known(depth)
            going = []
            for at in range(0, len(pending), TOGETHER):
                part = pending[at : at + TOGETHER]
                upper, lower = signed[part] @ most, signed[part] @ least
                itself = query_ids[part][:, None] == self.ids
                lower[itself] = -np.inf
                lower = np.concatenate([scores[part], lower], 1)
                needed = np.partition(lower, lower.shape[1] - k, 1)[:, lower.shape[1] - k]
                kept = (upper >= needed[:, None]) & ~itself
                stops = (kept.sum(1) <= few) | (depth == n)
                for j in np.flatnonzero(stops):
                    out[part[j]] = np.flatnonzero(kept[j]), depth * int(lists[part[j]])
                going.append(part[~stops])
            pending = np.concatenate(going)
            if not len(pending):
                break
        return out
