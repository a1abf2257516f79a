"""Pruning of old rows, one function for each dimension, and the whole sweep.

Every function gives the rows to delete, oldest first and at most ``batch`` of them
(a parameter that changes results: what is over goes in the next sweep). Orders are
total, so which rows go is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY_AGE_MS = 24 * 3_600_000
KEEP_PER_NAME = 1000
RECEIPT_AGE_MS = 7 * 24 * 3_600_000
BATCH = 1000
LEASE_MS = 30_000
#: Labels of the deletion counters.
TARGETS = ("completed", "failed", "receipt")
REASONS = ("age", "count", "orphan")


def effective_age(age_ms: int) -> int:
    """No age is shorter than two leases."""
    return max(age_ms, 2 * LEASE_MS)


def by_age(history: DataFrame, state: str, now_ms: int, age_ms: int = HISTORY_AGE_MS, batch: int = BATCH) -> DataFrame:
    old = history.where((F.col("state") == state) & (F.col("finished_at") < now_ms - effective_age(age_ms)))
    return old.orderBy("finished_at", "id").limit(batch)


def by_count(history: DataFrame, state: str, keep: int = KEEP_PER_NAME, batch: int = BATCH) -> DataFrame:
    """All but the newest ``keep`` of every name. The newest are found with a limit per group."""
    own = history.where(F.col("state") == state)
    w = Window.partitionBy("name").orderBy(F.desc("finished_at"), F.desc("id"))
    newest = own.select("id", "name", "finished_at").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).select("id")
    return own.join(newest, "id", "left_anti").orderBy("finished_at", "id").limit(batch)


def receipts(table: DataFrame, live: DataFrame, history: DataFrame, now_ms: int, age_ms: int = RECEIPT_AGE_MS, batch: int = BATCH) -> DataFrame:
    """Old receipts of jobs that are neither live nor in history."""
    ids = live.select(F.col("id").alias("job_id")).unionByName(history.select(F.col("id").alias("job_id")))
    old = table.where(F.col("created_at") < now_ms - age_ms).join(ids, "job_id", "left_anti")
    return old.orderBy("created_at", "queue_name", "idempotency_key").limit(batch)


def chain_counters(table: DataFrame, now_ms: int, age_ms: int = HISTORY_AGE_MS, batch: int = BATCH) -> DataFrame:
    return table.where(F.col("updated_at") < now_ms - age_ms).orderBy("updated_at", "trace_id").limit(batch)


def facet_dispatch(table: DataFrame, live: DataFrame, now_ms: int, age_ms: int = 60_000, batch: int = BATCH) -> DataFrame:
    """Idle facets without live jobs; unfaceted jobs count as the facet ''."""
    used = live.select(F.coalesce("rate_limit_facet", F.lit("")).alias("facet_key")).distinct()
    return table.where(F.col("last_served_at") < now_ms - age_ms).join(used, "facet_key", "left_anti").orderBy("last_served_at", "facet_key").limit(batch)


def rejections(table: DataFrame, now_ms: int, age_ms: int = HISTORY_AGE_MS, batch: int = BATCH) -> DataFrame:
    return table.where(F.col("rejected_at") < now_ms - age_ms).orderBy("rejected_at", "id").limit(batch)


def sweep(history: DataFrame, live: DataFrame, receipt_table: DataFrame, now_ms: int, age_ms: int = HISTORY_AGE_MS, keep: int = KEEP_PER_NAME, receipt_age_ms: int = RECEIPT_AGE_MS, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(deleted rows of history with ``state`` and ``reason``, deleted receipts), in the order of the dimensions.

    A later dimension sees the table as the ones before it have left it.
    """
    deleted = None
    for reason in ("age", "count"):
        for state in ("Completed", "Failed"):
            gone = by_age(history, state, now_ms, age_ms, batch) if reason == "age" else by_count(history, state, keep, batch)
            gone = gone.select("id", "state", F.lit(reason).alias("reason"))
            history = history.join(gone.select("id"), "id", "left_anti")
            deleted = gone if deleted is None else deleted.unionByName(gone)
    return deleted, receipts(receipt_table, live, history, now_ms, receipt_age_ms, batch)


def full_sweep(history: DataFrame, live: DataFrame, receipt_table: DataFrame, chains: DataFrame, turns: DataFrame, refused: DataFrame, now_ms: int, age_ms: int = HISTORY_AGE_MS, keep: int = KEEP_PER_NAME, receipt_age_ms: int = RECEIPT_AGE_MS, turn_age_ms: int = 60_000, batch: int = BATCH) -> dict[str, DataFrame]:
    """What each of the eight dimensions deletes, in their order: both states by age, both by count, receipts, chains, turns, refusals."""
    gone, orphans = sweep(history, live, receipt_table, now_ms, age_ms, keep, receipt_age_ms, batch)
    out = {f"{state.lower()}_{reason}": gone.where((F.col("state") == state) & (F.col("reason") == reason)) for reason in ("age", "count") for state in ("Completed", "Failed")}
    return out | {
        "receipts": orphans,
        "chain_counters": chain_counters(chains, now_ms, age_ms, batch),
        "facet_dispatch": facet_dispatch(turns, live, now_ms, turn_age_ms, batch),
        "rejections": rejections(refused, now_ms, age_ms, batch),
    }


def swept(dimensions: dict[str, DataFrame]) -> DataFrame:
    """(dimension, deleted) of a full sweep, zeros included."""
    out = None
    for name, rows in dimensions.items():
        n = rows.agg(F.count("*").alias("deleted")).select(F.lit(name).alias("dimension"), "deleted")
        out = n if out is None else out.unionByName(n)
    return out


def deleted_matrix(dimensions: DataFrame) -> DataFrame:
    """(target, reason, deleted) for every target and reason of the counters, from (dimension, deleted).

    Receipts go as orphans; what can't happen stays 0.
    """
    split = {"completed_age": ("completed", "age"), "failed_age": ("failed", "age"), "completed_count": ("completed", "count"), "failed_count": ("failed", "count"), "receipts": ("receipt", "orphan")}
    cells = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.lit(r).alias("reason"), F.lit(next((d for d, x in split.items() if x == (t, r)), None)).alias("dimension")) for t in TARGETS for r in REASONS)))
    every = dimensions.sparkSession.range(1).select(cells.alias("c")).select("c.*")
    return every.join(dimensions, "dimension", "left").select("target", "reason", F.coalesce("deleted", F.lit(0)).alias("deleted"))
