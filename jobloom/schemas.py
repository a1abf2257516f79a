"""Table schemas. Times are epoch milliseconds; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMON = "name string, state string, priority int, payload binary, parent_id string, trace_id string, execution_depth int, attempts int, max_attempts int, created_at long"
_TREE = "fail_parent_on_failure boolean, tree_id string, tree_depth int"

DDL = {
    "jobs": f"id string, {_COMMON}, updated_at long, rate_limit_facet string, worker_id string, last_error string, lease_expires_at_ms long, available_at long, retry_backoff_ms long, retry_backoff_max_ms long, retry_jitter double, pending_children int, {_TREE}",
    "job_history": f"id string, {_COMMON}, finished_at long, result binary, worker_id string, last_error string, rate_limit_facet string, {_TREE}",
    "enqueue_receipts": "queue_name string, idempotency_key string, request binary, job_id string, initial_state string, created_at long, release_on_finish boolean",
    "rate_limit_rules": "facet_pattern string, max_jobs long, window_duration_ms long",
    "rate_limit_counters": "facet_key string, current_count long, window_expires_at long",
    "ingress_limit_rules": "facet_pattern string, max_jobs long, window_duration_ms long",
    "ingress_limit_counters": "facet_key string, current_window_start long, current_count long, previous_count long",
    "chain_counters": "trace_id string, job_count long, updated_at long",
    "facet_dispatch": "facet_key string, last_served_seq long, last_served_at long",
    "enqueue_rejections": "id long, rejected_at long, kind string, name string, trace_id string, parent_id string, execution_depth int, rate_limit_facet string, detail string",
    "job_schedulers": "id string, job_name string, payload binary, cron string, timezone string, produced_count long, next_run_at long, last_job_id string, priority int, max_attempts int, retry_backoff_ms long, retry_backoff_max_ms long, retry_jitter double, rate_limit_facet string, created_at long, updated_at long",
    "lifecycle_events": "event_id long, ts long, name string, event string",
    "metric_samples": "ts long, metric string, labels map<string,string>, value double",
}

#: Values of columns that older tables lack.
DEFAULTS = {"attempts": 0, "max_attempts": 3, "retry_backoff_ms": 0, "retry_backoff_max_ms": 60_000, "retry_jitter": 0.0, "pending_children": 0, "fail_parent_on_failure": False, "tree_depth": 0, "release_on_finish": False, "produced_count": 0}

JOB_STATES = ("Waiting", "Delayed", "Active", "WaitingChildren", "Completed", "Failed")
TERMINAL = ("Completed", "Failed")


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(DDL[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Bring an older or partial table to the present schema.

    Missing columns get their default. An Active job without a lease has expired;
    a job that is not Delayed and has no due time was due when it was created, and
    a Delayed one without a due time stays unscheduled.
    """
    have = set(df.columns)
    cols = []
    for f in schema(table):
        c = F.col(f.name) if f.name in have else F.lit(None)
        if f.name in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[f.name]))
        if table == "jobs" and f.name == "lease_expires_at_ms":
            c = F.when((F.col("state") == "Active") & c.isNull(), 0).otherwise(c)
        if table == "jobs" and f.name == "available_at":
            c = F.when((F.col("state") != "Delayed") & c.isNull(), F.col("created_at")).otherwise(c)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def live_and_history(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """Both tables under one schema, with ``source`` telling them apart."""
    return jobs.withColumn("source", F.lit("live")).unionByName(history.withColumn("source", F.lit("history")), allowMissingColumns=True)
