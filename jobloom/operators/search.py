"""The read API: feeds, search, detail and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import blob_view, contains_ci, match_terms
from jobloom.schemas import live_and_history

LIMIT, MOST = 100, 1000
FAILURE_COLUMNS = ["id", "name", "attempts", "finished_at", "last_error", "trace_id", "execution_depth"]
SEARCH_COLUMNS = ["id", "name", "state", "attempts", "created_at", "finished_at", "last_error", "trace_id", "execution_depth"]
#: A job's own columns in its detail; ``source`` and both blobs with their encodings come on top.
DETAIL_COLUMNS = ["id", "name", "state", "priority", "attempts", "max_attempts", "created_at", "finished_at", "parent_id", "trace_id", "execution_depth", "rate_limit_facet", "last_error", "worker_id", "lease_expires_at_ms", "available_at"]
SCHEDULER_COLUMNS = ["id", "job_name", "payload", "cron", "timezone", "produced_count", "next_run_at", "last_job_id", "priority", "max_attempts", "retry_backoff_ms", "retry_backoff_max_ms", "retry_jitter", "rate_limit_facet", "created_at", "updated_at"]
LIKE_COLUMNS = ["id", "name", "trace_id", "last_error"]
TEXT_COLUMNS = ["name", "trace_id", "last_error"]


def _equal(**given: object) -> list[Column]:
    return [F.col(k) == v for k, v in given.items() if v is not None]


def _where(df: DataFrame, preds: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def _limit(limit: int | None) -> int:
    return max(0, min(LIMIT if limit is None else limit, MOST))


def failures(history: DataFrame, name: str | None = None, since_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """Failed jobs, newest first; ties by id."""
    preds = [F.col("state") == "Failed", *_equal(name=name)] + ([F.col("finished_at") >= since_ms] if since_ms is not None else [])
    return _where(history, preds).orderBy(F.desc("finished_at"), F.desc("id")).limit(_limit(limit)).select(*[c for c in FAILURE_COLUMNS if c in history.columns])


def rejections(log: DataFrame, kind: str | None = None, name: str | None = None, trace_id: str | None = None, since_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """Refused requests, newest first."""
    preds = _equal(kind=kind, name=name, trace_id=trace_id) + ([F.col("rejected_at") >= since_ms] if since_ms is not None else [])
    return _where(log, preds).orderBy(F.desc("rejected_at"), F.desc("id")).limit(_limit(limit))


def search(history: DataFrame, q: str | None = None, name: str | None = None, state: str | None = None, trace_id: str | None = None, since_ms: int | None = None, limit: int | None = None, full_text: bool = False) -> DataFrame:
    """Terminal jobs by substring (id included) or full text (id not included) and filters.

    At least one predicate must be given; a blank ``q`` is none.
    """
    q = (q or "").strip() or None
    preds = _equal(name=name, state=state, trace_id=trace_id)
    if since_ms is not None:
        preds.append(F.col("finished_at") >= since_ms)
    if q is not None:
        preds.append(match_terms(TEXT_COLUMNS, q) if full_text else contains_ci(LIKE_COLUMNS, q))
    if not preds:
        raise ValueError("at least one of q, name, state, trace_id and since_ms must be given")
    return _where(history, preds).orderBy(F.desc("finished_at"), F.desc("id")).limit(_limit(limit)).select(*[c for c in SEARCH_COLUMNS if c in history.columns])


def job_detail(jobs: DataFrame, history: DataFrame, job_id: str) -> DataFrame:
    """The job from the live table (``source`` live), else from history.

    Live rows show no end, error or result; rows of history no lease and no due time.
    ``payload`` and ``result`` are JSON text where their bytes hold that, else base64, as
    their encoding says; a missing blob has neither. An unknown id gives no row.
    """
    if not job_id.strip():
        raise ValueError("a job id must be given")
    live, past = (_hide(t.where(F.col("id") == job_id), c) for t, c in ((jobs, ("finished_at", "last_error", "result")), (history, ("lease_expires_at_ms", "available_at"))))
    both = live_and_history(live, past)
    for blob in ("payload", "result"):
        if blob in both.columns:
            text, encoding = blob_view(F.col(blob))
            both = both.withColumns({f"{blob}_encoding": encoding, blob: text})
    wanted = [*DETAIL_COLUMNS, "source", "payload", "payload_encoding", "result", "result_encoding"]
    return both.orderBy(F.desc("source")).limit(1).select(*[c for c in wanted if c in both.columns])


def _hide(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cols if c in df.columns})


def scheduler_list(table: DataFrame, scheduler_id: str | None = None) -> DataFrame:
    """All schedulers by id, or the one asked for."""
    own = _where(table, _equal(id=scheduler_id))
    return own.orderBy("id").select(*[c for c in SCHEDULER_COLUMNS if c in table.columns])


def lineage_view(history: DataFrame, trace_id: str, depths: DataFrame, limit: int | None = None) -> DataFrame:
    """The jobs of a trace, shallow ones first."""
    own = history.where(F.col("trace_id") == trace_id).join(depths.select("id", "depth"), "id", "left")
    return own.orderBy("depth", "id").limit(_limit(limit)).select("id", "name", "state", "depth", "finished_at")
