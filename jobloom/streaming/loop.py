"""The single-writer loop: micro-batches of requests against stored tables.

Each micro-batch is admitted whole before the next one starts. What it decides is
written under its number, so a batch that runs again after a failure replaces its
own output and nothing is admitted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.operators import admission

RECEIPT = "queue_name string, idempotency_key string, request string, job_id string, initial_state string, created_at long, release_on_finish boolean"
JOB = "id string, name string, state string, parent_id string, trace_id string, execution_depth int, rate_limit_facet string, created_at long, available_at long, seq long, window_start long, window_count long, window_before long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _read(spark: SparkSession, root: str, table: str, ddl: str, before: int) -> DataFrame:
    """Rows of a table that earlier batches have written. A store that fails to answer is an error, not an empty table."""
    if not _exists(spark, f"{root}/{table}"):
        return spark.createDataFrame([], T._parse_datatype_string(ddl))
    schema = T._parse_datatype_string(f"{ddl}, epoch long")
    return spark.read.schema(schema).parquet(f"{root}/{table}").where(F.col("epoch") < before).drop("epoch")


def admit_batch(batch: DataFrame, epoch: int, root: str, known: DataFrame | None = None, chain_cap: int = 0, max_depth: int = admission.MAX_DEPTH, limit: int | None = None, window_ms: int = 1) -> None:
    """One micro-batch of requests (seq, t_ms, name, request, and what else ``admission.admit`` reads).

    A job's id is the request's, or its number as text.
    """
    spark = batch.sparkSession
    receipts, jobs = _read(spark, root, "receipts", RECEIPT, epoch), _read(spark, root, "jobs", JOB, epoch)
    parents = jobs.select("id", "trace_id", "execution_depth")
    if known is not None:
        parents = parents.unionByName(known.select("id", "trace_id", "execution_depth"))
    if "id" not in batch.columns:
        batch = batch.withColumn("id", F.col("seq").cast("string"))
    counters = jobs.groupBy("trace_id").agg(F.count("*").alias("job_count"))
    last = jobs.where("window_start is not null").groupBy("rate_limit_facet").agg(F.max_by(F.struct("window_start", "window_count", "window_before"), F.struct("created_at", "seq")).alias("w"))
    windows = last.select(F.col("rate_limit_facet").alias("facet_key"), F.col("w.window_start").alias("current_window_start"), F.col("w.window_count").alias("current_count"), F.col("w.window_before").alias("previous_count"))
    fresh = F.concat(F.lit("trace-"), F.sha2(F.concat_ws(":", F.lit(root), F.lit(epoch).cast("string"), F.col("seq").cast("string")), 256))  # the same if the batch runs again
    decided = admission.admit(batch, parents, limit, window_ms, chain_cap, max_depth, receipts, counters, windows, fresh)
    where = lambda t: f"{root}/{t}/epoch={epoch}"
    decided.write.mode("overwrite").parquet(where("decisions"))
    done = spark.read.schema(decided.schema).parquet(where("decisions"))
    optional = lambda c, kind: F.col(c).cast(kind) if c in done.columns else F.lit(None).cast(kind)
    taken = done.where("status = 'accepted'")
    keyed = taken.where(F.coalesce(optional("idempotency_key", "string"), F.lit("")) != "")
    keyed.select(F.col("name").alias("queue_name"), optional("idempotency_key", "string").alias("idempotency_key"), "request", F.col("id").alias("job_id"), F.col("state").alias("initial_state"), F.col("t_ms").alias("created_at"), F.coalesce(optional("release_on_finish", "boolean"), F.lit(False)).alias("release_on_finish")).write.mode("overwrite").parquet(where("receipts"))
    made = taken.select("id", "name", "state", F.nullif(optional("parent_id", "string"), F.lit("")).alias("parent_id"), F.col("trace").alias("trace_id"), F.col("depth").cast("int").alias("execution_depth"), F.nullif(optional("facet", "string"), F.lit("")).alias("rate_limit_facet"), F.col("t_ms").alias("created_at"), "available_at", "seq", "window_start", "window_count", "window_before")
    made.write.mode("overwrite").parquet(where("jobs"))
    admission.rejection_log(done.withColumns({c: optional(c, "string") for c in ("parent_id", "facet")})).write.mode("overwrite").parquet(where("rejections"))


def run(requests: DataFrame, root: str, known: DataFrame | None = None, chain_cap: int = 0, max_depth: int = admission.MAX_DEPTH, limit: int | None = None, window_ms: int = 1) -> None:
    """Drain a stream of requests through ``admit_batch``."""
    writer = requests.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
    query = writer.foreachBatch(lambda df, epoch: admit_batch(df, epoch, root, known, chain_cap, max_depth, limit, window_ms)).start()
    query.awaitTermination()


def decisions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/decisions").drop("epoch")
