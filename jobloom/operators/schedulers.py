"""Schedulers: validation, what is due, and firing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions import cron
from jobloom.operators.limits import upsert

BATCH = 256
PAYLOAD_LIMIT = 1 << 20


def validate(schedulers: DataFrame) -> DataFrame:
    """``error`` of each definition; an empty time zone is none."""
    tz = F.nullif(F.col("timezone"), F.lit(""))
    blank = F.coalesce(*(F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"blank {c}") for c in ("id", "job_name", "cron")))
    jitter, base, cap = F.col("retry_jitter"), F.col("retry_backoff_ms"), F.col("retry_backoff_max_ms")
    numbers = F.when(F.isnan(jitter) | (jitter < 0) | (jitter > 1), "bad jitter").when((base < 0) | (cap < 0) | (cap < base), "bad backoff").when(F.octet_length("payload") > PAYLOAD_LIMIT, "large payload")
    return schedulers.withColumn("timezone", tz).withColumn("error", F.coalesce(blank, numbers, cron.problem(F.col("cron"), F.col("timezone"))))


def due(schedulers: DataFrame, now_ms: int, batch: int = BATCH) -> DataFrame:
    return schedulers.where(F.col("next_run_at") <= now_ms).orderBy("next_run_at", "id").limit(batch)


def fire(schedulers: DataFrame, now_ms: int, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(new jobs, schedulers after): one job for each due scheduler, the next run in the future.

    A scheduler that can't be parsed makes no job and holds up no other.
    """
    own = due(schedulers, now_ms, batch).withColumn("_next", cron.next_run(F.col("cron"), F.col("timezone"), F.lit(now_ms)))
    good = own.where(F.col("_next").isNotNull())
    job_id = F.concat_ws(":", F.col("id"), F.col("next_run_at").cast("string"))
    jobs = good.select(job_id.alias("id"), F.col("job_name").alias("name"), F.lit("Waiting").alias("state"), F.coalesce("priority", F.lit(0)).alias("priority"), "payload", F.lit(now_ms).alias("created_at"), F.lit(now_ms).alias("available_at"), F.col("id").alias("scheduler_id"))
    moved = good.select("id", F.col("_next").alias("next_run_at"), (F.col("produced_count") + 1).alias("produced_count"), job_id.alias("last_job_id"), F.lit(now_ms).alias("updated_at"))
    return jobs, upsert(schedulers, moved, ["id"])


def define(schedulers: DataFrame, definitions: DataFrame) -> DataFrame:
    """Insert or replace definitions; creation time, count and last job stay."""
    return upsert(schedulers, definitions, ["id"], keep=("created_at", "produced_count", "last_job_id"))
