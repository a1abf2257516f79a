"""The order in which due jobs are claimed."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.operators.limits import blocked_facets, small, upsert

#: Spans of age in which jobs are ranked, and turns of a rotation that are counted together.
SLOTS = 4096
SPAN = 4096


def due(now_ms: int) -> Column:
    return F.col("state").isin("Waiting", "Delayed") & F.coalesce(F.col("available_at") <= now_ms, F.lit(False))


def runnable(jobs: DataFrame, now_ms: int, rules: DataFrame | None = None, counters: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Due jobs of the given queues whose facet no rule blocks. Unfaceted jobs match no rule."""
    out = jobs.where(due(now_ms))
    if names:
        out = out.where(F.col("name").isin(names))
    if rules is not None:
        out = out.join(small(blocked_facets(rules, counters, now_ms)), "rate_limit_facet", "left_anti")
    return out


def fifo(jobs: DataFrame) -> DataFrame:
    """``position`` by priority, age and id.

    Jobs are ranked within their priority and one of ``SLOTS`` spans of age, and placed
    behind the earlier spans by running counts, of which there are ``SLOTS`` a priority.
    """
    ends = jobs.agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi")).first()
    lo, width = ends.lo or 0, ((ends.hi or 0) - (ends.lo or 0)) // SLOTS + 1
    rows = jobs.withColumn("_slot", F.expr(f"(created_at - {lo}L) div {width}L"))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("priority", "_slot").orderBy("created_at", "id")))
    rows = _behind(rows, rows, ["priority", "_slot"])
    return rows.withColumn("position", (F.col("_base") + F.col("_at")).cast("int")).drop("_slot", "_at", "_base")


def _behind(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """``_base``: how many of ``counted`` have smaller ``keys``; null keys count as the smallest."""
    counts = counted.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # over counts only
    base = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(base, reduce(lambda a, b: a & b, same)).drop(*(f"_k{i}" for i in range(len(keys))))


def claim_next(jobs: DataFrame) -> DataFrame:
    """The one job that the next poll gets."""
    return jobs.orderBy("priority", "created_at", "id").limit(1)


def within_limits(jobs: DataFrame, now_ms: int, rules: DataFrame, counters: DataFrame) -> DataFrame:
    """Of runnable jobs, those that claims at this instant can reach before their facet's window is full.

    A facet's jobs are claimed in the order of the queue, so what its window still
    allows is a prefix of them. Facets without a rule are left as they are.
    """
    c = rules.join(counters, rules["facet_pattern"] == counters["facet_key"], "left")
    used = F.when(F.coalesce(F.col("window_expires_at") > now_ms, F.lit(False)), F.col("current_count")).otherwise(0)
    room = small(c.select(F.col("facet_pattern").alias("rate_limit_facet"), F.greatest(F.col("max_jobs") - used, F.lit(0)).alias("_room")))
    out = jobs.join(room, "rate_limit_facet", "left")
    ruled = out.where(F.col("_room").isNotNull())
    w = Window.partitionBy("rate_limit_facet").orderBy("priority", "created_at", "id")
    ruled = ruled.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= F.col("_room")).drop("_nth")
    return out.where(F.col("_room").isNull()).unionByName(ruled).drop("_room")


def claim_batch(jobs: DataFrame, now_ms: int, n: int, rules: DataFrame, counters: DataFrame, served: DataFrame | None = None, rotate: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``n`` polls at one instant claim: (id, position), the counters after, and the facets' turns after.

    A claim counts in its facet's window, which opens with it where none is live, and
    gives its facet the latest turn. A job that polls can't reach for a limit is passed over.
    """
    open_ = within_limits(runnable(jobs, now_ms), now_ms, rules, counters)
    placed = fair(open_, served) if rotate else fifo(open_).withColumn("facet", F.coalesce("rate_limit_facet", F.lit("")))
    taken = placed.where(F.col("position") <= n).select("id", "facet", "position")
    per = taken.groupBy("facet").agg(F.count("*").alias("_n"), F.max("position").alias("_last"))
    ruled = rules.join(per, rules["facet_pattern"] == per["facet"]).drop("facet").join(counters, F.col("facet_pattern") == F.col("facet_key"), "left")
    live = F.coalesce(F.col("window_expires_at") > now_ms, F.lit(False))
    used = ruled.select(
        F.col("facet_pattern").alias("facet_key"),
        (F.when(live, F.col("current_count")).otherwise(0) + F.col("_n")).alias("current_count"),
        F.when(live, F.col("window_expires_at")).otherwise(F.lit(now_ms) + F.col("window_duration_ms")).alias("window_expires_at"),
    )
    had = served if served is not None else jobs.sparkSession.createDataFrame([], "facet_key string, last_served_seq long, last_served_at long")
    latest = had.agg(F.coalesce(F.max("last_served_seq"), F.lit(0)).alias("_seq"))  # one row
    turns = per.join(F.broadcast(latest)).select(F.col("facet").alias("facet_key"), (F.col("_seq") + F.col("_last")).alias("last_served_seq"), F.lit(now_ms).alias("last_served_at"))
    return taken.select("id", "position"), upsert(counters, used, ["facet_key"]), upsert(had, turns, ["facet_key"])


def throttled(jobs: DataFrame, now_ms: int, rules: DataFrame, counters: DataFrame) -> bool:
    """Whether any due job is held back by a limit. Without rules the backlog isn't read."""
    if rules.isEmpty():
        return False
    return not jobs.where(due(now_ms)).join(small(blocked_facets(rules, counters, now_ms)), "rate_limit_facet", "left_semi").isEmpty()


def fair(jobs: DataFrame, served: DataFrame | None = None) -> DataFrame:
    """``position`` under fair rotation, for a backlog drained from one claim to the next.

    Within a priority, facets take turns: the one served longest ago first (never
    served before all), then by the age of its oldest job. In a tier, the n-th job of
    every facet comes before any (n+1)-th, in the order of the facets' turns; how a
    tier leaves the rotation decides the next tier's turns.

    Only the turns are sequential, and they need one row per tier and facet. Jobs are
    ranked within their tier and facet, then within their tier and turn, and placed
    behind the earlier turns by running counts.
    """
    rows = jobs.withColumn("facet", F.coalesce("rate_limit_facet", F.lit("")))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("priority", "facet").orderBy("created_at", "id")))
    heads = rows.groupBy("priority", "facet").agg(F.count("*").alias("n"), F.min(F.struct("created_at", "id")).alias("h"))
    heads = heads.select("priority", "facet", "n", F.col("h.created_at").alias("head_at"), F.col("h.id").alias("head_id"))
    if served is not None:
        heads = heads.join(served.select(F.col("facet_key").alias("facet"), F.col("last_served_seq").alias("seq0")), "facet", "left")
    else:
        heads = heads.withColumn("seq0", F.lit(None).cast("long"))
    turns = heads.groupBy(F.lit(0).alias("_all")).applyInPandas(_turns, "priority int, facet string, turn long")
    rows = rows.join(turns, ["priority", "facet"])
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("priority", "rn").orderBy("turn")))
    # turns in spans of SPAN: counts before the span, and before the turn within it
    rows = rows.withColumn("_span", F.expr(f"rn div {SPAN}"))
    counts = rows.groupBy("priority", "_span", "rn").agg(F.count("*").alias("_n"))
    within = Window.partitionBy("priority", "_span").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("priority", "rn", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_in"))
    rows = _behind(rows, rows, ["priority", "_span"]).join(counts, ["priority", "rn"])
    return rows.withColumn("position", F.col("_base") + F.col("_in") + F.col("_at")).drop("_at", "_base", "_in", "_span", "rn", "turn")


def _turns(heads: pd.DataFrame) -> pd.DataFrame:
    """The order of the facets in every tier.

    A facet served in a tier was last served in its last turn there, so the order of
    last turns and, among equal ones, the order within the tier say who waits longest.
    """
    last = {r.facet: (0, int(r.seq0), 0) for r in heads.itertuples() if not pd.isna(r.seq0)}
    out = []
    for i, (_, tier) in enumerate(heads.sort_values("priority").groupby("priority", sort=True), 1):
        order = sorted(tier.itertuples(), key=lambda r: (last.get(r.facet, (-1, 0, 0)), r.head_at, r.head_id))
        for turn, r in enumerate(order):
            out.append((r.priority, r.facet, turn))
        last |= {r.facet: (i, int(r.n), turn) for turn, r in enumerate(order)}
    return pd.DataFrame(out, columns=["priority", "facet", "turn"])
