"""Counts, samples and histograms over jobs and lifecycle events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.text import escape_label
from jobloom.operators.dispatch import due
from jobloom.operators.lifecycle import expired

#: Upper bounds of the buckets, in ms and in microseconds.
DELAY_BOUNDS = (1, 10, 100, 500, 1_000, 5_000, 15_000, 60_000, 300_000, 3_600_000)
RPC_BOUNDS = (1_000, 5_000, 10_000, 50_000, 100_000, 1_000_000, 5_000_000)
#: The events that are counted over all queues.
EVENTS = ("enqueued", "claimed", "completed", "failed", "retried", "lease_expired")
KINDS = ("waiting", "delayed", "active", "due", "unscheduled", "expired_leases")


def state_counts(jobs: DataFrame, history: DataFrame) -> DataFrame:
    both = jobs.select("state").unionByName(history.select("state"))
    return both.groupBy("state").agg(F.count("*").alias("jobs"))


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def backlog(jobs: DataFrame, now_ms: int, by: Column | None = None) -> DataFrame:
    """A sample of the backlog by queue name (or by another key)."""
    is_due = due(now_ms)
    since = F.greatest("created_at", "available_at")
    oldest = F.greatest(F.lit(0).cast("long"), F.coalesce(now_ms - F.min(F.when(is_due, since)), F.lit(0).cast("long")))
    return jobs.groupBy((by if by is not None else F.col("name")).alias("name")).agg(
        _count_if(F.col("state") == "Waiting").alias("waiting"),
        _count_if(F.col("state") == "Delayed").alias("delayed"),
        _count_if(F.col("state") == "Active").alias("active"),
        _count_if(is_due).alias("due"),
        _count_if((F.col("state") == "Delayed") & F.col("available_at").isNull()).alias("unscheduled"),
        _count_if(expired(now_ms)).alias("expired_leases"),
        oldest.alias("oldest_due_age_ms"),
    )


def backlog_allowed(jobs: DataFrame, now_ms: int, allowed: list[str]) -> DataFrame:
    """Samples of the allowed queues, zeros for those without jobs, and a total (name null) over all queues."""
    spark = jobs.sparkSession
    sample = backlog(jobs, now_ms, F.when(F.col("name").isin(allowed), F.col("name")))
    names = spark.createDataFrame([(n,) for n in allowed], "name string")
    own = F.broadcast(names).join(sample.where("name is not null"), "name", "left").na.fill(0)
    total = sample.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in KINDS), F.coalesce(F.max("oldest_due_age_ms"), F.lit(0)).alias("oldest_due_age_ms"))
    return own.unionByName(total.withColumn("name", F.lit(None).cast("string")))


def histogram(values: DataFrame, value: Column, bounds: tuple[int, ...], by: list[str] | None = None, unit: float = 1000.0) -> DataFrame:
    """Cumulative buckets, long form: (by, le, n), and per group count and sum. Negative values count as 0.

    ``le`` is a bound, or null for all; ``total`` is in seconds if ``unit`` says how many make one.
    """
    by = by or []
    v = F.greatest(value, F.lit(0))
    rows = values.where(value.isNotNull()).select(*by, v.alias("_v"))
    sums = rows.groupBy(*by).agg(*(_count_if(F.col("_v") <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count("*").alias("count"), (F.sum("_v") / unit).alias("total"))
    cells = F.array(*(F.struct(F.lit(b).cast("long").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(None).cast("long").alias("le"), F.col("count").alias("n")))
    return sums.select(*by, "count", "total", F.explode(cells).alias("c")).select(*by, "c.le", "c.n", "count", "total")


def claim_delay(claims: DataFrame) -> Column:
    """First claim: from creation; a later attempt has none."""
    return F.when(F.col("attempts") == 1, F.greatest(F.col("claimed_at") - F.col("created_at"), F.lit(0)))


def due_wait(claims: DataFrame) -> Column:
    """Every claim: from when the job was due."""
    return F.greatest(F.col("claimed_at") - F.greatest("available_at", "created_at"), F.lit(0))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("name", "event").agg(F.count("*").alias("n"))


def transitions(log: DataFrame) -> DataFrame:
    """The events that committed transitions count, as (name, event, everywhere, named).

    ``log`` has (name, event, retried): ``failed`` is an accepted failure, ``lease_expired``
    a recovered job; either may be retried. All of them count ``everywhere``, with a
    ``retried`` beside them; by name, only a terminal one is ``failed``, a retried one is
    ``retried``, and an expired lease has no series of its own.
    """
    again = F.coalesce(F.col("retried"), F.lit(False))
    ended = F.col("event").isin("failed", "lease_expired")
    own = F.struct(F.col("event").alias("event"), F.lit(True).alias("everywhere"), (F.col("event") != "lease_expired") & ~(ended & again))
    retry = F.struct(F.lit("retried").alias("event"), F.lit(True).alias("everywhere"), F.lit(True))
    final = F.struct(F.lit("failed").alias("event"), F.lit(False).alias("everywhere"), F.lit(True))
    cells = F.when(ended & again, F.array(own, retry)).when(F.col("event") == "lease_expired", F.array(own, final)).otherwise(F.array(own))
    kind = "array<struct<event:string,everywhere:boolean,named:boolean>>"
    return log.select("name", F.explode(cells.cast(kind)).alias("c")).select("name", "c.*")


def transition_counts(log: DataFrame, preset: tuple[str, ...] = EVENTS) -> DataFrame:
    """(name, event, n): the counters over all queues (name null), zeros included, and those by name."""
    t = transitions(log)
    every = log.sparkSession.range(1).select(F.explode(F.array(*(F.lit(e) for e in preset))).alias("event"))
    total = every.join(t.where("everywhere").groupBy("event").agg(F.count("*").alias("n")), "event", "left")
    total = total.select(F.lit(None).cast("string").alias("name"), "event", F.coalesce("n", F.lit(0)).alias("n"))
    return total.unionByName(t.where("named").groupBy("name", "event").agg(F.count("*").alias("n")))


def histogram_lines(cells: DataFrame, metric: str, label: str, unit: float = 1e6) -> DataFrame:
    """Lines of a ``histogram``: buckets with bounds in seconds, count and sum, by one label."""
    own = F.concat(F.lit(f'{label}="'), escape_label(F.col(label)), F.lit('"'))
    bound = F.coalesce(_number(F.col("le") / unit), F.lit("+Inf"))
    bucket = cells.select(F.concat(F.lit(f"{metric}_bucket{{"), own, F.lit(',le="'), bound, F.lit('"} '), F.col("n").cast("string")).alias("line"))
    whole = cells.where("le is null")
    count = whole.select(F.concat(F.lit(f"{metric}_count{{"), own, F.lit("} "), F.col("count").cast("string")).alias("line"))
    total = whole.select(F.concat(F.lit(f"{metric}_sum{{"), own, F.lit("} "), _number(F.round("total", 6))).alias("line"))
    return bucket.unionByName(count).unionByName(total)


def _number(value: Column) -> Column:
    """A decimal without a trailing ``.0`` and without an exponent."""
    return F.regexp_replace(F.regexp_replace(value.cast("decimal(30, 6)").cast("string"), "0+$", ""), "\\.$", "")


def bounded_names(events: DataFrame, cap: int, preset: tuple[str, ...] = (), order: str = "ts", name: str = "name") -> DataFrame:
    """Named series up to a cap: preset names first, then names as they appear; others are counted as dropped.

    One row for each registered name, and one with a null name if anything was dropped.
    """
    seen = events.groupBy(name).agg(F.count("*").alias("n"), F.min(F.struct(order, "event_id")).alias("_first"))
    first = F.array_position(F.array(*(F.lit(p) for p in preset)), F.col(name)) if preset else F.lit(0)
    rank = F.row_number().over(Window.orderBy((first == 0).cast("int"), first, "_first", name))
    ranked = seen.withColumn("_rank", rank)
    return ranked.groupBy(F.when(F.col("_rank") <= cap, F.col(name)).alias("name")).agg(F.sum("n").alias("n"))


def exposition(samples: DataFrame, metric: str, labels: list[str], value: str = "value", kind: str = "gauge") -> DataFrame:
    """Lines of the text exposition format, sorted."""
    pairs = [F.concat(F.lit(f'{c}="'), escape_label(F.coalesce(F.col(c), F.lit(""))), F.lit('"')) for c in labels]
    head = F.concat(F.lit(metric), F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if labels else F.lit(metric)
    body = samples.select(F.concat_ws(" ", head, F.col(value).cast("string")).alias("line")).orderBy("line")
    top = samples.sparkSession.createDataFrame([(f"# TYPE {metric} {kind}",)], "line string")
    return top.unionByName(body)


#: The series that a client shows, their kinds and where their values come from.
CLIENT_SERIES = {
    "jobs_processed_total": ("counter", "processed"),
    "jobs_failed_total": ("counter", "failed"),
    "jobs_retried_total": ("counter", "retried"),
    "poll_failures_total": ("counter", "poll_failures"),
    "reconnects_total": ("counter", "reconnects"),
    "jobs_active": ("gauge", "active"),
    "connection_up": ("gauge", "connection_up"),
}


def client_lines(clients: DataFrame, prefix: str, labels: list[str]) -> DataFrame:
    """(series, kind, line) of every client, its labels in the given order; without labels, bare names."""
    pairs = [F.concat(F.lit(f'{c}="'), escape_label(F.coalesce(F.col(c), F.lit(""))), F.lit('"')) for c in labels]
    tags = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if labels else F.lit("")
    cells = F.array(*(F.struct(F.lit(s).alias("series"), F.lit(kind).alias("kind"), F.concat(F.lit(prefix + s), tags, F.lit(" "), F.col(c).cast("string")).alias("line")) for s, (kind, c) in CLIENT_SERIES.items()))
    return clients.select(F.explode(cells).alias("c")).select("c.*")
