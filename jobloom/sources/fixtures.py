"""Job tables derived from the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fixed clock of the derived tables: 1998-01-01 UTC.
NOW_MS = 883_612_800_000
DAY_MS = 86_400_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def epoch_ms(ts: str) -> Column:
    return F.expr(f"unix_micros(cast({ts} as timestamp)) div 1000")


def job_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per order, live and terminal."""
    o = load(spark, sf_dir, "orders")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("o_orderkey")
    created = epoch_ms("o_orderdate") + (k * 7919) % DAY_MS
    state = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "O", "Completed").when(k % 4 == 0, "Waiting").when(k % 4 == 2, "Active").otherwise("Delayed")
    error = F.when(k % 5 == 0, "connection timeout contacting upstream-service").when(k % 5 == 1, "Invalid payload schema").when(k % 5 == 2, "100% rate_limit exceeded").when(k % 5 == 3, "dependency unavailable")
    facet = F.when(k % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("tenant:"), F.lower("c_mktsegment")))
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(
        k.cast("string").alias("id"),
        F.concat(F.lit("q"), (F.col("o_custkey") % 8).cast("string")).alias("name"),
        state.alias("state"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.when(k >= 4, F.expr("o_orderkey div 4").cast("string")).alias("parent_id"),
        F.concat(F.lit("trace-"), (F.col("o_custkey") % 97).cast("string")).alias("trace_id"),
        facet.alias("rate_limit_facet"),
        (1 + k % 3).cast("int").alias("attempts"),
        F.lit(3).alias("max_attempts"),
        created.alias("created_at"),
        (created + F.floor("o_totalprice") * 10).alias("finished_at"),
        F.when(k % 50 == 3, F.lit(None)).otherwise(created + (k % 4) * DAY_MS).alias("available_at"),
        F.when((F.col("o_orderstatus") == "P") & (k % 4 == 2) & (k % 12 != 2), created + 30_000).alias("lease_expires_at_ms"),
        F.when(F.col("o_orderstatus") == "F", error).alias("last_error"),
        k.alias("k"),
    )


JOB_ALL_SQL = f"""
j0 AS (SELECT *, epoch_us(o_orderdate) // 1000 + (o_orderkey * 7919) % {DAY_MS} AS created FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
job_all AS (SELECT o_orderkey::VARCHAR AS id, 'q' || (o_custkey % 8)::VARCHAR AS name,
  CASE WHEN o_orderstatus = 'F' THEN 'Failed' WHEN o_orderstatus = 'O' THEN 'Completed' WHEN o_orderkey % 4 = 0 THEN 'Waiting' WHEN o_orderkey % 4 = 2 THEN 'Active' ELSE 'Delayed' END AS state,
  left(o_orderpriority, 1)::INTEGER AS priority, CASE WHEN o_orderkey >= 4 THEN (o_orderkey // 4)::VARCHAR END AS parent_id,
  'trace-' || (o_custkey % 97)::VARCHAR AS trace_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'tenant:' || lower(c_mktsegment) END AS rate_limit_facet,
  (1 + o_orderkey % 3)::INTEGER AS attempts, 3 AS max_attempts, created AS created_at, created + floor(o_totalprice)::BIGINT * 10 AS finished_at,
  CASE WHEN o_orderkey % 50 = 3 THEN NULL ELSE created + (o_orderkey % 4) * {DAY_MS} END AS available_at,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 2 AND o_orderkey % 12 <> 2 THEN created + 30000 END AS lease_expires_at_ms,
  CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 5 WHEN 0 THEN 'connection timeout contacting upstream-service' WHEN 1 THEN 'Invalid payload schema' WHEN 2 THEN '100% rate_limit exceeded' WHEN 3 THEN 'dependency unavailable' END END AS last_error,
  o_orderkey AS k FROM j0),
jobs AS (SELECT * FROM job_all WHERE state NOT IN ('Completed', 'Failed')),
job_history AS (SELECT * FROM job_all WHERE state IN ('Completed', 'Failed'))"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_all(spark, sf_dir).where(~F.col("state").isin("Completed", "Failed"))


def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_all(spark, sf_dir).where(F.col("state").isin("Completed", "Failed"))


def details(rows: DataFrame) -> DataFrame:
    """Jobs with depth, payload, result and worker: payloads are JSON or other bytes."""
    k, ended = F.col("k"), F.col("state").isin("Active", "Completed", "Failed")
    payload = F.when(k % 3 == 0, F.concat(F.lit("raw "), F.col("id"))).otherwise(F.concat(F.lit('{"order":'), F.col("id"), F.lit("}")))
    result = F.when((F.col("state") == "Completed") & (k % 2 == 0), F.concat(F.lit("["), F.col("id"), F.lit("]")))
    return rows.withColumns({"execution_depth": (k % 12).cast("int"), "payload": payload.cast("binary"), "result": result.cast("binary"), "worker_id": F.when(ended, F.concat(F.lit("w"), (k % 8).cast("string")))})


DETAIL_SQL = """
details AS (SELECT *, (k % 12)::INTEGER AS execution_depth, CASE WHEN k % 3 = 0 THEN encode('raw ' || id) ELSE encode('{"order":' || id || '}') END AS payload,
  CASE WHEN state = 'Completed' AND k % 2 = 0 THEN encode('[' || id || ']') END AS result, CASE WHEN state IN ('Active', 'Completed', 'Failed') THEN 'w' || (k % 8) END AS worker_id FROM job_all)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enqueue requests, one per event, in the order (t_ms, seq)."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        epoch_ms("ts").alias("t_ms"),
        F.col("event_type").alias("name"),
        F.col("event_type").alias("facet"),
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("idempotency_key"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("trace_id"),
        F.col("props").alias("request"),
        (F.floor("value") % 3 * 1000).alias("delay_ms"),
        "user_id",
        "value",
    )


REQUESTS_SQL = """
requests AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS t_ms, event_type AS name, event_type AS facet, event_type || ':' || user_id::VARCHAR AS idempotency_key,
  'u' || user_id::VARCHAR AS trace_id, props AS request, floor(value)::BIGINT % 3 * 1000 AS delay_ms, user_id, value FROM events)"""

#: What each event type stands for in the lifecycle log.
EVENT_OF = {"view": "enqueued", "click": "claimed", "purchase": "completed", "error": "failed", "signup": "retried"}


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    event = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in EVENT_OF.items()))
    return e.select("event_id", epoch_ms("ts").alias("ts"), F.concat(F.lit("q"), (F.col("user_id") % 8).cast("string")).alias("name"), event.alias("event"))


LIFECYCLE_SQL = """
lifecycle_events AS (SELECT event_id, epoch_us(ts) // 1000 AS ts, 'q' || (user_id % 8)::VARCHAR AS name,
  CASE event_type WHEN 'view' THEN 'enqueued' WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'retried' END AS event FROM events)"""


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly samples of a counter per (name, event): events so far, restarted once in the middle."""
    e = lifecycle_events(spark, sf_dir)
    hourly = e.groupBy("name", "event", F.expr("ts div 3600000 * 3600000 + 3600000").alias("ts")).agg(F.count("*").alias("n"))
    ends = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    mid = (ends.lo + ends.hi) // 2 if ends.lo is not None else 0
    w = Window.partitionBy("name", "event", "restarted").orderBy("ts")
    return hourly.withColumn("restarted", F.col("ts") > mid).select("name", "event", "ts", F.sum("n").over(w).cast("double").alias("value"))


COUNTER_SQL = (
    LIFECYCLE_SQL
    + """,
hourly AS (SELECT name, event, ts // 3600000 * 3600000 + 3600000 AS ts, count(*) AS n FROM lifecycle_events GROUP BY ALL),
samples AS (SELECT name, event, ts, (sum(n) OVER (PARTITION BY name, event, ts > mid ORDER BY ts))::DOUBLE AS value FROM hourly, (SELECT (min(ts) + max(ts)) // 2 AS mid FROM lifecycle_events))"""
)


def rate_rules(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, counters, facet_dispatch) with every case of a limit."""
    rules = spark.createDataFrame([("tenant:building", 0, 60_000), ("tenant:machinery", 5, 60_000), ("tenant:automobile", 1_000_000, 60_000)], "facet_pattern string, max_jobs long, window_duration_ms long")
    counters = spark.createDataFrame([("tenant:machinery", 5, NOW_MS + 1), ("tenant:automobile", 3, NOW_MS - 1)], "facet_key string, current_count long, window_expires_at long")
    served = spark.createDataFrame([("tenant:automobile", 1, NOW_MS - 300_000), ("tenant:furniture", 2, NOW_MS - 200_000), ("tenant:idle", 3, NOW_MS - 100_000)], "facet_key string, last_served_seq long, last_served_at long")
    return rules, counters, served


RULES_SQL = f"""
rules(facet_pattern, max_jobs, window_duration_ms) AS (VALUES ('tenant:building', 0, 60000), ('tenant:machinery', 5, 60000), ('tenant:automobile', 1000000, 60000)),
counters(facet_key, current_count, window_expires_at) AS (VALUES ('tenant:machinery', 5, {NOW_MS + 1}), ('tenant:automobile', 3, {NOW_MS - 1})),
facet_dispatch(facet_key, last_served_seq, last_served_at) AS (VALUES ('tenant:automobile', 1, {NOW_MS - 300_000}), ('tenant:furniture', 2, {NOW_MS - 200_000}), ('tenant:idle', 3, {NOW_MS - 100_000}))"""


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for every third job, and orphans."""
    j = job_all(spark, sf_dir)
    key = F.concat(F.lit("key-"), F.col("id"))
    own = j.where(F.col("k") % 3 == 0).select(F.col("name").alias("queue_name"), key.alias("idempotency_key"), F.col("id").alias("job_id"), F.col("created_at"), (F.col("k") % 2 == 1).alias("release_on_finish"))
    gone = j.where(F.col("k") % 11 == 0).select(F.col("name").alias("queue_name"), F.concat(key, F.lit("-gone")).alias("idempotency_key"), F.concat(F.lit("gone-"), F.col("id")).alias("job_id"), F.col("created_at"), F.lit(False).alias("release_on_finish"))
    return own.unionByName(gone)


RECEIPTS_SQL = """
receipts AS (SELECT name AS queue_name, 'key-' || id AS idempotency_key, id AS job_id, created_at, k % 2 = 1 AS release_on_finish FROM job_all WHERE k % 3 = 0
  UNION ALL SELECT name, 'key-' || id || '-gone', 'gone-' || id, created_at, false FROM job_all WHERE k % 11 = 0)"""
