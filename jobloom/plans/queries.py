"""The registered queries: each applies an operator to tables derived from the given ones.

``QUERIES`` maps a name to (spark, sf_dir) -> DataFrame, ``ORACLES`` to the same query in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.operators import admission, client, dispatch, flows, lifecycle, limits, loadreport, metrics, retention, schedulers, search, timeseries
from jobloom.sources import fixtures as fx
from jobloom.sources.fixtures import COUNTER_SQL, JOB_ALL_SQL, LIFECYCLE_SQL, NOW_MS, RECEIPTS_SQL, REQUESTS_SQL, RULES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR = 3_600_000
INGRESS_LIMIT, INGRESS_WINDOW = 12, 21_600_000


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _j(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join((JOB_ALL_SQL, *ctes)) + "\n" + body


DUE = f"state IN ('Waiting', 'Delayed') AND coalesce(available_at <= {NOW_MS}, false)"
EXPIRED = f"state = 'Active' AND coalesce(lease_expires_at_ms, 0) <= {NOW_MS}"
_SAMPLE = f"""count(*) FILTER (state = 'Waiting') AS waiting, count(*) FILTER (state = 'Delayed') AS delayed, count(*) FILTER (state = 'Active') AS active,
  count(*) FILTER ({DUE}) AS due, count(*) FILTER (state = 'Delayed' AND available_at IS NULL) AS unscheduled, count(*) FILTER ({EXPIRED}) AS expired_leases,
  greatest(0, coalesce({NOW_MS} - min(greatest(created_at, available_at)) FILTER ({DUE}), 0)) AS oldest_due_age_ms"""


# ---- counts and samples


@register(_j("SELECT state, count(*) AS jobs FROM job_all GROUP BY state"))
def state_counts(spark, sf):
    return metrics.state_counts(fx.jobs(spark, sf), fx.job_history(spark, sf))


@register(_j(f"SELECT name, {_SAMPLE} FROM jobs GROUP BY name"))
def backlog_pressure(spark, sf):
    return metrics.backlog(fx.jobs(spark, sf), NOW_MS)


@register(
    _j(
        f"""SELECT a.name, coalesce(waiting, 0) AS waiting, coalesce(delayed, 0) AS delayed, coalesce(active, 0) AS active, coalesce(due, 0) AS due, coalesce(unscheduled, 0) AS unscheduled,
  coalesce(expired_leases, 0) AS expired_leases, coalesce(oldest_due_age_ms, 0) AS oldest_due_age_ms FROM (VALUES ('q1'), ('q3'), ('empty')) a(name) LEFT JOIN (SELECT name, {_SAMPLE} FROM jobs GROUP BY name) s USING (name)
  UNION ALL SELECT NULL, {_SAMPLE} FROM jobs"""
    )
)
def backlog_pressure_allowlist(spark, sf):
    return metrics.backlog_allowed(fx.jobs(spark, sf), NOW_MS, ["q1", "q3", "empty"])


# ---- feeds and search

_FAIL = "id, name, attempts, finished_at, last_error, trace_id, (k % 12)::INTEGER AS execution_depth"
_SEARCH = "id, name, state, attempts, created_at, finished_at, last_error, trace_id, (k % 12)::INTEGER AS execution_depth"


def _history(spark, sf):
    return fx.details(fx.job_history(spark, sf))


@register(_j(f"SELECT {_FAIL} FROM job_history WHERE state = 'Failed' ORDER BY finished_at DESC, id DESC LIMIT 100"))
def failures_feed(spark, sf):
    return search.failures(_history(spark, sf))


@register(_j(f"SELECT {_FAIL} FROM job_history WHERE state = 'Failed' AND name = 'q2' AND finished_at >= 800000000000 ORDER BY finished_at DESC, id DESC LIMIT 50"))
def failures_feed_filtered(spark, sf):
    return search.failures(_history(spark, sf), name="q2", since_ms=800_000_000_000, limit=50)


@register(_j(f"SELECT {_SEARCH} FROM job_history WHERE id ILIKE '%100\\%%' ESCAPE '\\' OR name ILIKE '%100\\%%' ESCAPE '\\' OR trace_id ILIKE '%100\\%%' ESCAPE '\\' OR last_error ILIKE '%100\\%%' ESCAPE '\\' ORDER BY finished_at DESC, id DESC LIMIT 1000"))
def search_like(spark, sf):
    return search.search(_history(spark, sf), q="100%", limit=5000)


def _tok(c: str) -> str:
    return f"(' ' || array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ')"


def _any(needle: str) -> str:
    return "(" + " OR ".join(f"contains({_tok(c)}, '{needle}')" for c in search.TEXT_COLUMNS) + ")"


@register(_j(f"SELECT {_SEARCH} FROM job_history WHERE {_any(' upstream service ')} ORDER BY finished_at DESC, id DESC LIMIT 1000"))
def search_fts_phrase(spark, sf):
    return search.search(_history(spark, sf), q="upstream-service", limit=1000, full_text=True)


@register(_j(f"SELECT {_SEARCH} FROM job_history WHERE {_any(' unavail')} AND {_any(' depend')} ORDER BY finished_at DESC, id DESC LIMIT 200"))
def search_fts_prefix(spark, sf):
    return search.search(_history(spark, sf), q="unavail* depend*", limit=200, full_text=True)


@register(_j(f"SELECT {_SEARCH} FROM job_history WHERE {_any(' payload ')} AND name = 'q1' AND state = 'Failed' AND finished_at >= 750000000000 ORDER BY finished_at DESC, id DESC LIMIT 100"))
def search_fts_and_filters(spark, sf):
    return search.search(_history(spark, sf), q='"Payload"', name="q1", state="Failed", since_ms=750_000_000_000, full_text=True)


@register("SELECT doc_id, lang FROM documents WHERE contains((' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' '), ' the of ')")
def documents_phrase(spark, sf):
    from jobloom.functions.text import token_text

    docs = fx.load(spark, sf, "documents")
    return docs.where(token_text(F.col("text")).contains(" the of ")).select("doc_id", "lang")


def _blob_sql(blob: str, is_json: str) -> str:
    return f"CASE WHEN {is_json} THEN decode({blob}) ELSE base64({blob}) END AS {blob}, CASE WHEN {blob} IS NULL THEN NULL WHEN {is_json} THEN 'json' ELSE 'base64' END AS {blob}_encoding"


_DETAIL_IDS = ("2", "3", "7", "9", "14", "38")


@register(
    _j(
        f"""SELECT id, name, state, source, priority, attempts, max_attempts, created_at, CASE WHEN past THEN finished_at END AS finished_at, parent_id, trace_id, execution_depth, rate_limit_facet, CASE WHEN past THEN last_error END AS last_error, worker_id,
  CASE WHEN NOT past THEN lease_expires_at_ms END AS lease_expires_at_ms, CASE WHEN NOT past THEN available_at END AS available_at, {_blob_sql("payload", "k % 3 <> 0")}, {_blob_sql("result", "result IS NOT NULL")}
FROM (SELECT *, state IN ('Completed', 'Failed') AS past, CASE WHEN state IN ('Completed', 'Failed') THEN 'history' ELSE 'live' END AS source FROM details) WHERE id IN {_DETAIL_IDS}""",
        fx.DETAIL_SQL,
    )
)
def job_detail(spark, sf):
    live, out = fx.details(fx.jobs(spark, sf)), None
    for job_id in _DETAIL_IDS:
        one = search.job_detail(live, _history(spark, sf), job_id)
        out = one if out is None else out.unionByName(one)
    return out


_DEPTHS = """depths(id, depth, root) AS (SELECT id, 0, id FROM job_all WHERE parent_id IS NULL UNION ALL SELECT j.id, d.depth + 1, d.root FROM depths d JOIN job_all j ON j.parent_id = d.id WHERE d.depth < 12)"""


@register(_j("SELECT j.id, d.depth, d.root FROM job_all j LEFT JOIN depths d ON d.id = j.id", _DEPTHS))
def lineage_depth(spark, sf):
    return flows.depths(fx.job_all(spark, sf), max_height=12)


@register(_j("SELECT h.id, h.name, h.state, depth, finished_at FROM job_history h LEFT JOIN depths d ON h.id = d.id WHERE trace_id = 'trace-5' ORDER BY depth NULLS FIRST, h.id LIMIT 1000", _DEPTHS))
def lineage_view(spark, sf):
    return search.lineage_view(fx.job_history(spark, sf), "trace-5", flows.depths(fx.job_all(spark, sf), max_height=12), limit=1000)


@register(_j("SELECT start, step, id FROM up", "up(start, step, id, parent_id) AS (SELECT id, 0, id, parent_id FROM job_all WHERE id IN ('999', '1001', '5') UNION ALL SELECT up.start, up.step + 1, j.id, j.parent_id FROM up JOIN job_all j ON up.parent_id = j.id)"))
def lineage_ancestors(spark, sf):
    return flows.lineage(fx.job_all(spark, sf), ["999", "1001", "5"], 12)


@register(_j("SELECT parent_id, count(*) AS pending FROM jobs WHERE parent_id IS NOT NULL GROUP BY parent_id"))
def tree_pending(spark, sf):
    return flows.pending_children(fx.jobs(spark, sf))


@register(_j("SELECT parent_id, string_agg(id || '=r' || id, ',' ORDER BY id) AS results FROM job_history WHERE state = 'Completed' AND parent_id IS NOT NULL AND k % 3 <> 1 GROUP BY parent_id"))
def children_values(spark, sf):
    h = fx.job_history(spark, sf).withColumn("result", F.when(F.col("k") % 3 != 1, F.concat(F.lit("r"), "id").cast("binary")))
    got = flows.children_values(h)
    pairs = F.transform(F.array_sort(F.map_entries("results")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return got.select("parent_id", F.array_join(pairs, ",").alias("results"))


# ---- retention

_AGE = NOW_MS - 200 * 86_400_000


@register(_j(f"SELECT id, finished_at FROM job_history WHERE state = 'Completed' AND finished_at < {_AGE} ORDER BY finished_at, id LIMIT 1000"))
def prune_age(spark, sf):
    return retention.by_age(fx.job_history(spark, sf), "Completed", NOW_MS, 200 * 86_400_000).select("id", "finished_at")


@register(_j("SELECT id, name, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY finished_at DESC, id DESC) AS rn FROM job_history WHERE state = 'Failed') WHERE rn > 50 ORDER BY finished_at, id LIMIT 1000"))
def prune_count(spark, sf):
    return retention.by_count(fx.job_history(spark, sf), "Failed", keep=50).select("id", "name", "finished_at")


@register(_j(f"SELECT r.queue_name, r.idempotency_key FROM receipts r WHERE created_at < {NOW_MS - retention.RECEIPT_AGE_MS} AND NOT EXISTS (SELECT 1 FROM job_all j WHERE j.id = r.job_id) ORDER BY created_at, queue_name, idempotency_key LIMIT 1000", RECEIPTS_SQL))
def prune_receipts_orphans(spark, sf):
    return retention.receipts(fx.receipts(spark, sf), fx.jobs(spark, sf), fx.job_history(spark, sf), NOW_MS).select("queue_name", "idempotency_key")


@register(_j(f"SELECT facet_key, last_served_seq FROM facet_dispatch f WHERE last_served_at < {NOW_MS - 60_000} AND NOT EXISTS (SELECT 1 FROM jobs j WHERE coalesce(j.rate_limit_facet, '') = f.facet_key)", RULES_SQL))
def prune_facet_dispatch(spark, sf):
    return retention.facet_dispatch(fx.rate_rules(spark)[2], fx.jobs(spark, sf), NOW_MS).select("facet_key", "last_served_seq")


@register(_j(f"SELECT trace_id, job_count FROM (SELECT trace_id, count(*) AS job_count, max(created_at) AS updated_at FROM job_all GROUP BY trace_id) WHERE updated_at < {NOW_MS}"))
def prune_chain_counters(spark, sf):
    counters = fx.job_all(spark, sf).groupBy("trace_id").agg(F.count("*").alias("job_count"), F.max("created_at").alias("updated_at"))
    return retention.chain_counters(counters, NOW_MS, 0).select("trace_id", "job_count")


@register(f"WITH {REQUESTS_SQL} SELECT seq AS id FROM requests WHERE name = 'error' AND t_ms < 1705000000000 ORDER BY t_ms, seq LIMIT 1000")
def prune_rejections(spark, sf):
    log = fx.requests(spark, sf).where("name = 'error'").select(F.col("seq").alias("id"), F.col("t_ms").alias("rejected_at"))
    return retention.rejections(log, 1_705_000_000_000, 0).select("id")


_SWEEP = f"""
a1 AS (SELECT id, state, 'age' AS reason FROM job_history WHERE state = 'Completed' AND finished_at < {_AGE} ORDER BY finished_at, id LIMIT 1000),
h1 AS (SELECT * FROM job_history ANTI JOIN a1 USING (id)),
a2 AS (SELECT id, state, 'age' AS reason FROM h1 WHERE state = 'Failed' AND finished_at < {_AGE} ORDER BY finished_at, id LIMIT 1000),
h2 AS (SELECT * FROM h1 ANTI JOIN a2 USING (id)),
a3 AS (SELECT id, state, 'count' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY finished_at DESC, id DESC) AS rn FROM h2 WHERE state = 'Completed') WHERE rn > 100 ORDER BY finished_at, id LIMIT 1000),
h3 AS (SELECT * FROM h2 ANTI JOIN a3 USING (id)),
a4 AS (SELECT id, state, 'count' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY finished_at DESC, id DESC) AS rn FROM h3 WHERE state = 'Failed') WHERE rn > 100 ORDER BY finished_at, id LIMIT 1000)"""


@register(_j("SELECT state, reason, count(*) AS deleted FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4) GROUP BY state, reason", _SWEEP))
def sweep_outcome(spark, sf):
    gone, _ = retention.sweep(fx.job_history(spark, sf), fx.jobs(spark, sf), fx.receipts(spark, sf), NOW_MS, 200 * 86_400_000, 100)
    return gone.groupBy("state", "reason").agg(F.count("*").alias("deleted"))


_CHAINS = "SELECT trace_id FROM (SELECT trace_id, max(created_at) AS updated_at FROM job_all GROUP BY trace_id) WHERE updated_at < " + str(NOW_MS - 200 * 86_400_000) + " ORDER BY updated_at, trace_id LIMIT 1000"
_LOG = f"SELECT id FROM job_all WHERE state = 'Failed' AND finished_at < {_AGE} ORDER BY finished_at, id LIMIT 1000"
_DIMENSIONS = f"""
h4 AS (SELECT * FROM h3 ANTI JOIN a4 USING (id)),
dims(dimension, deleted) AS (SELECT 'completed_age', (SELECT count(*) FROM a1) UNION ALL SELECT 'failed_age', (SELECT count(*) FROM a2) UNION ALL SELECT 'completed_count', (SELECT count(*) FROM a3) UNION ALL SELECT 'failed_count', (SELECT count(*) FROM a4)
  UNION ALL SELECT 'receipts', (SELECT count(*) FROM (SELECT 1 FROM receipts r WHERE created_at < {NOW_MS - retention.RECEIPT_AGE_MS} AND NOT EXISTS (SELECT 1 FROM h4 WHERE h4.id = r.job_id) AND NOT EXISTS (SELECT 1 FROM jobs WHERE jobs.id = r.job_id) LIMIT 1000))
  UNION ALL SELECT 'chain_counters', (SELECT count(*) FROM ({_CHAINS})) UNION ALL SELECT 'facet_dispatch', (SELECT count(*) FROM facet_dispatch f WHERE last_served_at < {NOW_MS - 60_000} AND NOT EXISTS (SELECT 1 FROM jobs j WHERE coalesce(j.rate_limit_facet, '') = f.facet_key))
  UNION ALL SELECT 'rejections', (SELECT count(*) FROM ({_LOG})))"""


def _dimensions(spark, sf):
    chains = fx.job_all(spark, sf).groupBy("trace_id").agg(F.max("created_at").alias("updated_at"))
    refused = fx.job_history(spark, sf).where("state = 'Failed'").select("id", F.col("finished_at").alias("rejected_at"))
    return retention.swept(retention.full_sweep(fx.job_history(spark, sf), fx.jobs(spark, sf), fx.receipts(spark, sf), chains, fx.rate_rules(spark)[2], refused, NOW_MS, 200 * 86_400_000, 100))


@register(_j("SELECT dimension, deleted FROM dims", _SWEEP, RECEIPTS_SQL, RULES_SQL, _DIMENSIONS))
def sweep_dimensions(spark, sf):
    return _dimensions(spark, sf)


@register(
    _j(
        "SELECT target, reason, coalesce(deleted, 0) AS deleted FROM (VALUES ('completed'), ('failed'), ('receipt')) t(target), (VALUES ('age'), ('count'), ('orphan')) r(reason) LEFT JOIN dims ON dimension = CASE WHEN target = 'receipt' AND reason = 'orphan' THEN 'receipts' ELSE target || '_' || reason END",
        _SWEEP, RECEIPTS_SQL, RULES_SQL, _DIMENSIONS,
    )
)
def deleted_matrix(spark, sf):
    return retention.deleted_matrix(_dimensions(spark, sf))


# ---- lifecycle


def _waiting_parents(spark, sf):
    j = fx.job_all(spark, sf)
    return j.select("id", "parent_id", F.when(F.col("k") % 5 == 0, "Completed").otherwise("WaitingChildren").alias("state"), (F.col("k") % 3 != 0).alias("fail_parent_on_failure"), F.when(F.col("k") % 7 == 0, 1).otherwise(2).alias("pending_children"), "available_at", "k")


_WAITING = "wp AS (SELECT id, parent_id, CASE WHEN k % 5 = 0 THEN 'Completed' ELSE 'WaitingChildren' END AS state, k % 3 <> 0 AS flag, CASE WHEN k % 7 = 0 THEN 1 ELSE 2 END AS pending, available_at, k FROM job_all)"


@register(
    _j(
        f"""SELECT w.id, (pending - done)::INTEGER AS pending_children, CASE WHEN pending - done <= 0 AND state = 'WaitingChildren' THEN CASE WHEN coalesce(available_at > {NOW_MS}, false) THEN 'Delayed' ELSE 'Waiting' END ELSE state END AS state
  FROM wp w JOIN (SELECT parent_id AS id, count(*) AS done FROM job_history WHERE state = 'Completed' AND parent_id IS NOT NULL GROUP BY parent_id) d USING (id)""",
        _WAITING,
    )
)
def parent_release(spark, sf):
    done = fx.job_history(spark, sf).where("state = 'Completed'").select("id", "parent_id")
    return lifecycle.parent_release(_waiting_parents(spark, sf), done, NOW_MS).select("id", "pending_children", "state")


@register(
    _j(
        """SELECT id, min(cause) AS cause, 'failParentOnFailure: child ' || min(cause) || ' failed' AS last_error FROM up GROUP BY id""",
        _WAITING,
        """wf AS (SELECT wp.* REPLACE (CASE WHEN j.state = 'Failed' THEN 'Failed' ELSE wp.state END AS state) FROM wp JOIN job_all j USING (id)),
f AS (SELECT id FROM job_all WHERE state = 'Failed'),
up(id, cause, flag, parent_id, step) AS (
  SELECT p.id, c.id, p.flag, p.parent_id, 1 FROM f JOIN wf c ON c.id = f.id JOIN wf p ON p.id = c.parent_id WHERE c.flag AND p.state NOT IN ('Completed', 'Failed')
  UNION ALL SELECT p.id, up.cause, p.flag, p.parent_id, step + 1 FROM up JOIN wf p ON p.id = up.parent_id WHERE up.flag AND p.state NOT IN ('Completed', 'Failed') AND step < 10)""",
    )
)
def fail_parent_cascade(spark, sf):
    """Every failed job takes its parents along."""
    failed = fx.job_all(spark, sf).where("state = 'Failed'").select("id")
    nodes = _waiting_parents(spark, sf).join(failed.withColumn("_failed", F.lit(True)), "id", "left").withColumn("state", F.when(F.col("_failed"), "Failed").otherwise(F.col("state"))).drop("_failed")
    return lifecycle.fail_parents(nodes, failed)


def _backoff(jobs):
    return jobs.withColumns({"retry_backoff_ms": F.col("k") % 3 * 250, "retry_backoff_max_ms": F.lit(600).cast("long"), "retry_jitter": F.lit(0.5)})


_DELAY = "CASE WHEN k % 3 = 0 THEN 0 ELSE least(600, (k % 3 * 250) * (1 << (attempts - 1))) END"


@register(_j(f"SELECT id, CASE WHEN attempts < max_attempts THEN CASE WHEN {_DELAY} > 0 THEN 'Delayed' ELSE 'Waiting' END ELSE 'Failed' END AS state, CASE WHEN attempts < max_attempts THEN {NOW_MS} + {_DELAY} ELSE available_at END AS available_at, 'Worker lease expired' AS last_error FROM (SELECT * FROM jobs WHERE {EXPIRED} ORDER BY coalesce(lease_expires_at_ms, 0), id LIMIT 100)"))
def lease_recovery(spark, sf):
    return lifecycle.recover_leases(_backoff(fx.jobs(spark, sf)), NOW_MS).select("id", "state", "available_at", "last_error")


@register(_j(f"SELECT id, CASE WHEN attempts < max_attempts THEN CASE WHEN d > 0 THEN 'Delayed' ELSE 'Waiting' END ELSE 'Failed' END AS state, CASE WHEN attempts < max_attempts THEN d END AS delay_ms FROM (SELECT *, greatest(0, least({_DELAY}, round(0.5 * ({_DELAY}) + 0.5 * ((k % 11) / 10.0) * ({_DELAY}))::BIGINT)) AS d FROM jobs WHERE state = 'Active')"))
def retry_schedule(spark, sf):
    active = _backoff(fx.jobs(spark, sf).where("state = 'Active'"))
    return lifecycle.retry(active, NOW_MS, draw=(F.col("k") % 11) / 10.0).select("id", "state", "delay_ms")


@register(_j("SELECT state, count(*) AS jobs FROM (SELECT CASE WHEN state = 'Active' AND k % 3 = 0 THEN 'Completed' ELSE state END AS state FROM job_all) GROUP BY state"))
def complete_transitions(spark, sf):
    live, history = fx.jobs(spark, sf), fx.job_history(spark, sf)
    ended = live.where("state = 'Active' and k % 3 = 0").select("id", F.lit("Completed").alias("state"), F.lit(NOW_MS).alias("finished_at"))
    live, history = lifecycle.archive(live, history, ended)
    return metrics.state_counts(live, history)


def _calls(spark, sf):
    j = fx.job_all(spark, sf)
    return j.select("id", F.concat(F.lit("w"), (F.col("k") % 4).cast("string")).alias("worker_id"), F.when(F.col("k") % 5 == 0, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempt"))


def _owned(df):
    return df.withColumn("worker_id", F.concat(F.lit("w"), (F.col("k") % 8).cast("string")))


@register(
    _j(
        f"""SELECT result, count(*) AS calls FROM (SELECT CASE WHEN coalesce(j.state = 'Active' AND j.w = c.w AND j.attempts = c.attempt AND coalesce(j.lease_expires_at_ms, 0) > 650000000000, false) THEN 'ok'
  WHEN coalesce(h.state = 'Completed' AND h.w = c.w AND h.attempts = c.attempt, false) THEN 'replay' WHEN j.id IS NOT NULL OR h.id IS NOT NULL THEN 'conflict' ELSE 'not_found' END AS result
  FROM (SELECT id, 'w' || (k % 4) AS w, CASE WHEN k % 5 = 0 THEN attempts + 1 ELSE attempts END AS attempt FROM job_all UNION ALL SELECT 'nobody', 'w1', 1) c
  LEFT JOIN (SELECT *, 'w' || (k % 8) AS w FROM jobs) j USING (id) LEFT JOIN (SELECT *, 'w' || (k % 8) AS w FROM job_history) h USING (id)) GROUP BY result"""
    )
)
def completion_replay(spark, sf):
    calls = _calls(spark, sf).unionByName(spark.createDataFrame([("nobody", "w1", 1)], "id string, worker_id string, attempt int"))
    got = lifecycle.acknowledgement(_owned(fx.jobs(spark, sf)), _owned(fx.job_history(spark, sf)), calls, 650_000_000_000)
    return got.groupBy("result").agg(F.count("*").alias("calls"))


@register(_j("SELECT id, greatest(lease_expires_at_ms, 650000000000 + 30000) AS lease_expires_at_ms FROM jobs WHERE state = 'Active' AND coalesce(lease_expires_at_ms, 0) > 650000000000 AND k % 5 <> 0 AND k % 4 = k % 8"))
def heartbeat(spark, sf):
    return lifecycle.heartbeat(_owned(fx.jobs(spark, sf)), _calls(spark, sf), 650_000_000_000)


@register(_j("SELECT queue_name, idempotency_key FROM receipts r WHERE NOT (release_on_finish AND EXISTS (SELECT 1 FROM job_history h WHERE h.id = r.job_id AND h.state = 'Completed'))", RECEIPTS_SQL))
def receipt_release(spark, sf):
    ended = fx.job_history(spark, sf).where("state = 'Completed'").select("id")
    return lifecycle.release_receipts(fx.receipts(spark, sf), ended).select("queue_name", "idempotency_key")


# ---- dispatch and limits


@register(_j(f"SELECT id, row_number() OVER (ORDER BY priority, created_at, id)::INTEGER AS position FROM jobs WHERE {DUE}"))
def dispatch_fifo(spark, sf):
    return dispatch.fifo(dispatch.runnable(fx.jobs(spark, sf), NOW_MS)).select("id", "position")


def _fair_sql(body: str | None = None, source: str = f"jobs WHERE {DUE}", *more: str) -> str:
    """The tiers chained: ranks within a facet (r), positions (o), the turns that they leave (s)."""
    ctes = [RULES_SQL, *more, f"d AS (SELECT id, priority, created_at, coalesce(rate_limit_facet, '') AS facet FROM {source})", "s0 AS (SELECT facet_key AS facet, last_served_seq AS seq FROM facet_dispatch)", "n0 AS (SELECT 0::BIGINT AS n)"]
    parts = []
    for p in range(1, 6):
        ctes += [
            f"r{p} AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY created_at, id) AS rn, first_value(created_at) OVER (PARTITION BY facet ORDER BY created_at, id) AS hc, first_value(id) OVER (PARTITION BY facet ORDER BY created_at, id) AS hi FROM d WHERE priority = {p})",
            f"o{p} AS (SELECT r.*, n.n + row_number() OVER (ORDER BY rn, coalesce(s.seq, 0), hc, hi) AS position FROM r{p} r LEFT JOIN s{p - 1} s USING (facet), n{p - 1} n)",
            f"s{p} AS (SELECT facet, max(seq) AS seq FROM (SELECT facet, 1000 + max(position) AS seq FROM o{p} GROUP BY facet UNION ALL SELECT facet, seq FROM s{p - 1}) GROUP BY facet)",
            f"n{p} AS (SELECT n + (SELECT count(*) FROM o{p}) AS n FROM n{p - 1})",
        ]
        parts.append(f"SELECT id, facet, position FROM o{p}")
    return _j(" UNION ALL ".join(parts) if body is None else body, *ctes, "placed AS (" + " UNION ALL ".join(parts) + ")")


@register(_fair_sql())
def dispatch_fair(spark, sf):
    jobs = dispatch.runnable(fx.jobs(spark, sf), NOW_MS)
    return dispatch.fair(jobs, fx.rate_rules(spark)[2]).select("id", "facet", "position")


_BLOCKED = f"blocked AS (SELECT facet_pattern FROM rules LEFT JOIN counters ON facet_pattern = facet_key WHERE max_jobs <= 0 OR coalesce(window_expires_at > {NOW_MS} AND current_count >= max_jobs, false))"


@register(_j(f"SELECT rate_limit_facet, count(*) AS held_back FROM jobs WHERE {DUE} AND rate_limit_facet IN (SELECT facet_pattern FROM blocked) GROUP BY rate_limit_facet", RULES_SQL, _BLOCKED))
def throttled_facets(spark, sf):
    rules, counters, _ = fx.rate_rules(spark)
    held = fx.jobs(spark, sf).where(dispatch.due(NOW_MS)).join(limits.small(limits.blocked_facets(rules, counters, NOW_MS)), "rate_limit_facet", "left_semi")
    return held.groupBy("rate_limit_facet").agg(F.count("*").alias("held_back"))


@register(_j(f"SELECT id, priority, created_at FROM jobs WHERE {DUE} AND name IN ('q1', 'q5') AND coalesce(rate_limit_facet NOT IN (SELECT facet_pattern FROM blocked), true) ORDER BY priority, created_at, id LIMIT 1", RULES_SQL, _BLOCKED))
def claim_next(spark, sf):
    rules, counters, _ = fx.rate_rules(spark)
    return dispatch.claim_next(dispatch.runnable(fx.jobs(spark, sf), NOW_MS, rules, counters, ["q1", "q5"])).select("id", "priority", "created_at")


#: Polls at one instant, and rules of which one blocks, one has room left, one's window is over and one is never full.
POLLS = 400
CLAIM_RULES = [("tenant:building", 0, 60_000), ("tenant:machinery", 25, 60_000), ("tenant:automobile", 40, 30_000), ("tenant:household", 1_000_000, 60_000)]
CLAIM_COUNTERS = [("tenant:machinery", 5, NOW_MS + 1), ("tenant:automobile", 40, NOW_MS - 1), ("tenant:gone", 7, NOW_MS + 9)]
_ROOM = f"""
crules(facet, max_jobs, window_ms) AS (VALUES {", ".join(f"('{f}', {m}::BIGINT, {w}::BIGINT)" for f, m, w in CLAIM_RULES)}),
ccounters(facet, used, until) AS (VALUES {", ".join(f"('{f}', {n}::BIGINT, {u}::BIGINT)" for f, n, u in CLAIM_COUNTERS)}),
room AS (SELECT facet, greatest(max_jobs - CASE WHEN coalesce(until > {NOW_MS}, false) THEN used ELSE 0 END, 0) AS room FROM crules LEFT JOIN ccounters USING (facet)),
reachable AS (SELECT * FROM (SELECT j.*, row_number() OVER (PARTITION BY rate_limit_facet ORDER BY priority, created_at, id) AS nth, room FROM jobs j LEFT JOIN room ON facet = rate_limit_facet WHERE {DUE}) WHERE room IS NULL OR nth <= room)"""
_TAKEN = f"taken AS (SELECT id, coalesce(rate_limit_facet, '') AS facet, row_number() OVER (ORDER BY priority, created_at, id) AS position FROM reachable QUALIFY position <= {POLLS})"


def _claimed(spark, sf, rotate):
    rules = spark.createDataFrame(CLAIM_RULES, "facet_pattern string, max_jobs long, window_duration_ms long")
    counters = spark.createDataFrame(CLAIM_COUNTERS, "facet_key string, current_count long, window_expires_at long")
    return dispatch.claim_batch(fx.jobs(spark, sf), NOW_MS, POLLS, rules, counters, fx.rate_rules(spark)[2], rotate)


@register(_j("SELECT id, position::INTEGER AS position FROM taken", _ROOM, _TAKEN))
def claim_batch(spark, sf):
    return _claimed(spark, sf, False)[0].select("id", "position")


@register(_j(f"SELECT coalesce(c.facet, t.facet) AS facet_key, CASE WHEN n IS NULL THEN used WHEN coalesce(until > {NOW_MS}, false) THEN used + n ELSE n END AS current_count, CASE WHEN n IS NULL OR coalesce(until > {NOW_MS}, false) THEN until ELSE {NOW_MS} + window_ms END AS window_expires_at FROM ccounters c FULL JOIN (SELECT facet, window_ms, count(*) AS n FROM taken JOIN crules USING (facet) GROUP BY ALL) t ON c.facet = t.facet", _ROOM, _TAKEN))
def claim_counters(spark, sf):
    return _claimed(spark, sf, False)[1]


@register(_fair_sql(f"SELECT id, position FROM placed WHERE position <= {POLLS}", "reachable", _ROOM))
def claim_rotation(spark, sf):
    return _claimed(spark, sf, True)[0]


@register(_fair_sql(f"SELECT coalesce(f.facet_key, t.facet) AS facet_key, coalesce((SELECT max(last_served_seq) FROM facet_dispatch) + t.last, f.last_served_seq)::BIGINT AS last_served_seq, CASE WHEN t.last IS NULL THEN f.last_served_at ELSE {NOW_MS} END AS last_served_at FROM facet_dispatch f FULL JOIN (SELECT facet, max(position) AS last FROM placed WHERE position <= {POLLS} GROUP BY facet) t ON f.facet_key = t.facet", "reachable", _ROOM))
def claim_turns(spark, sf):
    return _claimed(spark, sf, True)[2]


@register(f"WITH {RULES_SQL} SELECT facet_pattern, max_jobs::BIGINT AS max_jobs, window_duration_ms::BIGINT AS window_duration_ms, CASE WHEN live THEN current_count ELSE 0 END::BIGINT AS current_count, CASE WHEN live THEN window_expires_at END AS window_expires_at, max_jobs <= 0 OR (live AND current_count >= max_jobs) AS throttled FROM (SELECT *, coalesce(window_expires_at > {NOW_MS}, false) AS live FROM rules LEFT JOIN counters ON facet_pattern = facet_key)")
def rate_limit_status(spark, sf):
    rules, counters, _ = fx.rate_rules(spark)
    return limits.fixed_status(rules, counters, NOW_MS)


_INGRESS_COUNTERS = "ic AS (SELECT event_type AS facet_key, min(epoch_us(ts) // 1000) AS current_window_start, count(*) FILTER (user_id % 2 = 0) AS current_count, count(*) FILTER (user_id % 2 = 1) AS previous_count FROM events GROUP BY event_type)"
_STATUS_AT = 1_704_078_000_000


@register(
    f"""WITH {_INGRESS_COUNTERS}, r AS (SELECT DISTINCT event_type AS facet_pattern, 12::BIGINT AS max_jobs, 43200000::BIGINT AS w FROM events UNION ALL SELECT 'none', 0, 43200000),
s AS (SELECT *, CASE WHEN {_STATUS_AT} - current_window_start >= 0 THEN ({_STATUS_AT} - current_window_start) // w ELSE 0 END AS steps FROM r LEFT JOIN ic ON facet_pattern = facet_key),
t AS (SELECT facet_pattern, max_jobs, w, CASE WHEN steps = 0 THEN current_window_start WHEN steps = 1 THEN current_window_start + w ELSE {_STATUS_AT} - ({_STATUS_AT} - current_window_start) % w END AS window_start, CASE WHEN steps = 0 THEN current_count ELSE 0 END AS cur, CASE WHEN steps = 0 THEN previous_count WHEN steps = 1 THEN current_count ELSE 0 END AS prev FROM s),
e AS (SELECT *, CASE WHEN window_start IS NULL THEN 0 ELSE prev * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (w - ({_STATUS_AT} - window_start))::DOUBLE / w)) + cur END AS est FROM t)
SELECT facet_pattern, max_jobs, w AS window_duration_ms, window_start, round(est)::BIGINT AS estimated_count, max_jobs <= 0 OR est >= max_jobs AS throttled FROM e"""
)
def ingress_status(spark, sf):
    e = fx.load(spark, sf, "events")
    odd = F.when(F.col("user_id") % 2 == 1, 1)
    counters = e.groupBy(F.col("event_type").alias("facet_key")).agg(F.min(fx.epoch_ms("ts")).alias("current_window_start"), F.count(F.when(F.col("user_id") % 2 == 0, 1)).alias("current_count"), F.count(odd).alias("previous_count"))
    rules = e.select(F.col("event_type").alias("facet_pattern")).distinct().withColumn("max_jobs", F.lit(12).cast("long")).unionByName(spark.createDataFrame([("none", 0)], "facet_pattern string, max_jobs long")).withColumn("window_duration_ms", F.lit(43_200_000).cast("long"))
    return limits.sliding_status(rules, counters, _STATUS_AT)


_SLIDE = f"""
n AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY t_ms, seq) AS i FROM requests),
f(facet, i, seq, admitted, s, c, p) AS (
  SELECT facet, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, NULL::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT facet FROM n)
  UNION ALL
  SELECT facet, i, seq, ok, CASE WHEN ok THEN rs ELSE s END, CASE WHEN ok THEN rc + 1 ELSE c END, CASE WHEN ok THEN rp ELSE p END FROM (
    SELECT *, rp * greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({INGRESS_WINDOW} - (t_ms - rs))::DOUBLE / {INGRESS_WINDOW})) + rc < {INGRESS_LIMIT} AS ok FROM (
      SELECT n.facet, n.i, n.seq, n.t_ms, f.s, f.c, f.p,
        CASE WHEN f.s IS NULL THEN n.t_ms WHEN (n.t_ms - f.s) // {INGRESS_WINDOW} <= 0 THEN f.s WHEN (n.t_ms - f.s) // {INGRESS_WINDOW} = 1 THEN f.s + {INGRESS_WINDOW} ELSE n.t_ms - (n.t_ms - f.s) % {INGRESS_WINDOW} END AS rs,
        CASE WHEN f.s IS NULL OR (n.t_ms - f.s) // {INGRESS_WINDOW} > 0 THEN 0 ELSE f.c END AS rc,
        CASE WHEN f.s IS NULL THEN 0 WHEN (n.t_ms - f.s) // {INGRESS_WINDOW} <= 0 THEN f.p WHEN (n.t_ms - f.s) // {INGRESS_WINDOW} = 1 THEN f.c ELSE 0 END AS rp
      FROM f JOIN n ON n.facet = f.facet AND n.i = f.i + 1)))"""


@register(f"WITH RECURSIVE {REQUESTS_SQL}, {_SLIDE} SELECT seq, facet, admitted FROM f WHERE i > 0")
def ingress_admission(spark, sf):
    return limits.sliding_admission(fx.requests(spark, sf).select("seq", "t_ms", "facet"), INGRESS_LIMIT, INGRESS_WINDOW).select("seq", "facet", "admitted")


_FIXED = f"""
n AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY t_ms, seq) AS i FROM requests),
f(facet, i, seq, admitted, c, e) AS (
  SELECT facet, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT facet FROM n)
  UNION ALL
  SELECT n.facet, n.i, n.seq, NOT (f.e > n.t_ms AND f.c >= {INGRESS_LIMIT}), CASE WHEN f.e > n.t_ms THEN least(f.c + 1, {INGRESS_LIMIT}) ELSE 1 END, CASE WHEN f.e > n.t_ms THEN f.e ELSE n.t_ms + {INGRESS_WINDOW} END
  FROM f JOIN n ON n.facet = f.facet AND n.i = f.i + 1)"""


@register(f"WITH RECURSIVE {REQUESTS_SQL}, {_FIXED} SELECT seq, facet, admitted FROM f WHERE i > 0")
def fixed_window_claims(spark, sf):
    return limits.fixed_window_admission(fx.requests(spark, sf).select("seq", "t_ms", "facet"), INGRESS_LIMIT, INGRESS_WINDOW).select("seq", "facet", "admitted")


# ---- admission

_FIRST = "fr AS (SELECT *, first_value(seq) OVER w AS first_seq, first_value(request) OVER w AS first_request FROM requests WINDOW w AS (PARTITION BY name, idempotency_key ORDER BY t_ms, seq))"
_OUTCOME = "CASE WHEN seq = first_seq THEN 'new' WHEN request = first_request THEN 'replay' ELSE 'conflict' END"


@register(f"WITH {REQUESTS_SQL}, {_FIRST} SELECT seq, {_OUTCOME} AS outcome, first_seq FROM fr")
def dedup_receipts(spark, sf):
    return admission.dedup(fx.requests(spark, sf)).select("seq", "outcome", "first_seq")


@register(f"WITH {REQUESTS_SQL}, {_FIRST} SELECT name, count(*) AS conflicts FROM fr WHERE {_OUTCOME} = 'conflict' GROUP BY name")
def receipt_conflicts(spark, sf):
    return admission.dedup(fx.requests(spark, sf)).where("outcome = 'conflict'").groupBy("name").agg(F.count("*").alias("conflicts"))


@register(f"WITH {REQUESTS_SQL} SELECT seq, row_number() OVER (PARTITION BY trace_id ORDER BY t_ms, seq) <= 25 AS within_quota FROM requests")
def chain_quarantine(spark, sf):
    return admission.quarantine(fx.requests(spark, sf), 25).select("seq", "within_quota")


def _children(spark, sf):
    """Requests that name a parent among the jobs, some missing, some with a depth of their own."""
    r = fx.requests(spark, sf)
    seq = F.col("seq")
    return r.withColumns({"parent_id": F.when(seq % 5 == 0, "").when(seq % 17 == 1, F.concat(F.lit("none-"), seq.cast("string"))).otherwise((seq % 3000).cast("string")), "execution_depth": F.when(seq % 4 == 0, 2).otherwise(0)})


def _known(spark, sf):
    return flows.depths(fx.job_all(spark, sf), max_height=12).where("depth is not null").select("id", F.concat(F.lit("t-"), "root").alias("trace_id"), F.col("depth").alias("execution_depth"))


_CHILDREN = """rc AS (SELECT *, CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 17 = 1 THEN 'none-' || seq ELSE (seq % 3000)::VARCHAR END AS parent_id, CASE WHEN seq % 4 = 0 THEN 2 ELSE 0 END AS given FROM requests),
ra AS (SELECT rc.*, CASE WHEN parent_id IS NOT NULL AND d.id IS NOT NULL THEN d.depth + 1 ELSE given END AS depth, CASE WHEN parent_id IS NOT NULL AND d.id IS NOT NULL THEN 't-' || d.root ELSE rc.trace_id END AS trace, d.id AS pid FROM rc LEFT JOIN depths d ON d.id = rc.parent_id),
rr AS (SELECT *, CASE WHEN parent_id IS NOT NULL AND pid IS NULL THEN 'parent_not_found' WHEN parent_id IS NOT NULL AND given <> 0 AND given <> depth THEN 'inconsistent_depth' WHEN depth > 8 THEN 'circuit_breaker' END AS rejection FROM ra)"""


@register(_j("SELECT seq, depth, trace, rejection FROM rr", REQUESTS_SQL, _DEPTHS, _CHILDREN))
def ancestry_check(spark, sf):
    return admission.resolve_ancestry(_children(spark, sf), _known(spark, sf), max_depth=8).select("seq", "depth", "trace", "rejection")


#: So few that every gate of the pipeline refuses some request.
ADMIT_LIMIT = 2


def _asked(spark, sf):
    # every 13th root comes without a lineage; requests are parents under their own ids
    r = _children(spark, sf).withColumn("trace_id", F.when(F.col("seq") % 13 == 0, "").otherwise(F.col("trace_id")))
    r = r.withColumn("parent_id", F.when(F.col("seq") % 7 == 3, F.concat(F.lit("r-"), F.expr("cast(seq div 2 AS string)"))).otherwise(F.col("parent_id")))
    return r.withColumn("id", F.concat(F.lit("r-"), F.col("seq").cast("string")))


def _admitted(spark, sf):
    fresh = F.concat(F.lit("new-"), F.col("seq").cast("string"))
    return admission.admit(_asked(spark, sf), _known(spark, sf), ADMIT_LIMIT, INGRESS_WINDOW, chain_cap=3, max_depth=8, new_trace=fresh)


@register()
def admission_pipeline(spark, sf):
    """All gates by one writer; tests compare it with a plain one."""
    return _admitted(spark, sf).select("seq", "status", "depth", "trace", "first_seq", "state", "available_at")


@register()
def rejections_by_kind(spark, sf):
    log = admission.rejection_log(_admitted(spark, sf))
    return log.groupBy("kind", admission.rejection_group().alias("grp")).agg(F.count("*").alias("n"))


@register()
def rejections_feed(spark, sf):
    log = admission.rejection_log(_admitted(spark, sf)).withColumn("id", F.col("seq"))
    return search.rejections(log, limit=200).select("seq", "kind", "rejected_at", "trace_id", "parent_id", "execution_depth", "rate_limit_facet", "detail")


@register(f"WITH {REQUESTS_SQL}, b AS (SELECT seq, seq // 40 AS batch_id, seq % 40 AS pos, value < 200 AS ok FROM requests), g AS (SELECT batch_id, min(pos) FILTER (NOT ok) AS bad FROM b GROUP BY batch_id) SELECT seq, bad IS NULL AS committed, CASE WHEN bad IS NOT NULL THEN 'bulk job ' || bad || ': rejected' END AS batch_error FROM b JOIN g USING (batch_id)")
def bulk_atomic(spark, sf):
    r = fx.requests(spark, sf).select("seq", F.expr("seq div 40").alias("batch_id"), (F.col("seq") % 40).alias("pos"), (F.col("value") < 200).alias("ok"))
    return admission.gate_batches(r).select("seq", "committed", "batch_error")


@register(f"WITH {REQUESTS_SQL} SELECT seq, CASE WHEN seq % 7 = 0 THEN 'blank key' WHEN seq % 11 = 0 THEN 'negative delay' WHEN seq % 13 = 0 THEN 'bad jitter' END AS invalid, CASE WHEN seq % 2 = 0 THEN 60000 ELSE 90000 END AS retry_backoff_max_ms, CASE WHEN seq % 3 = 0 THEN 3 ELSE seq % 3 END AS max_attempts FROM requests")
def validate_requests(spark, sf):
    seq = F.col("seq")
    r = fx.requests(spark, sf).withColumns({"idempotency_key": F.when(seq % 7 == 0, "  ").otherwise(F.col("idempotency_key")), "delay_ms": F.when(seq % 11 == 0, -1).otherwise(F.col("delay_ms")), "retry_jitter": F.when(seq % 13 == 0, float("nan")).otherwise(0.5), "retry_backoff_ms": F.when(seq % 2 == 0, 10).otherwise(90_000), "max_attempts": seq % 3})
    return admission.validate(r).select("seq", "invalid", "retry_backoff_max_ms", "max_attempts")


# ---- histograms, rates and alerts


def _hist_sql(values: str, bounds: tuple[int, ...], by: str, unit: float = 1000.0) -> str:
    rows = ", ".join(f"({b})" for b in bounds)
    return f"SELECT {by}, le, count(*) FILTER (le IS NULL OR v <= le) AS n, count(*) AS count, sum(v) / {unit} AS total FROM ({values}), (VALUES {rows}, (NULL)) b(le) WHERE v IS NOT NULL GROUP BY {by}, le"


def _claims(spark, sf):
    return fx.job_all(spark, sf).withColumn("claimed_at", F.col("created_at") + F.col("k") * 37 % 4_000_000)


@register(_j(_hist_sql("SELECT name, CASE WHEN attempts = 1 THEN greatest(k * 37 % 4000000, 0) END AS v FROM job_all", metrics.DELAY_BOUNDS, "name")))
def claim_delay_histogram(spark, sf):
    c = _claims(spark, sf)
    return metrics.histogram(c, metrics.claim_delay(c), metrics.DELAY_BOUNDS, ["name"])


@register(_j(_hist_sql("SELECT name, greatest(created_at + k * 37 % 4000000 - greatest(available_at, created_at), 0) AS v FROM job_all", metrics.DELAY_BOUNDS, "name")))
def due_wait_histogram(spark, sf):
    c = _claims(spark, sf)
    return metrics.histogram(c, metrics.due_wait(c), metrics.DELAY_BOUNDS, ["name"])


@register(_j(_hist_sql("SELECT name, finished_at - created_at AS v FROM job_history", metrics.DELAY_BOUNDS, "name")))
def duration_histogram(spark, sf):
    h = fx.job_history(spark, sf)
    return metrics.histogram(h, F.col("finished_at") - F.col("created_at"), metrics.DELAY_BOUNDS, ["name"])


@register(_hist_sql("SELECT event_type AS method, floor(value * 1000)::BIGINT AS v FROM events", metrics.RPC_BOUNDS, "method", 1e6))
def rpc_latency_histogram(spark, sf):
    e = fx.load(spark, sf, "events").withColumn("method", F.col("event_type"))
    return metrics.histogram(e, F.floor(F.col("value") * 1000), metrics.RPC_BOUNDS, ["method"], 1e6)


@register(
    "WITH b AS (" + _hist_sql("SELECT event_type AS method, floor(value * 1000)::BIGINT AS v FROM events", metrics.RPC_BOUNDS, "method", 1e6) + """),
w AS (SELECT method, le, n, count, lag(le, 1, 0) OVER o AS lo, lag(n, 1, 0) OVER o AS ln, row_number() OVER o AS i FROM b WINDOW o AS (PARTITION BY method ORDER BY le NULLS LAST)),
h AS (SELECT method, min(i) FILTER (n >= 0.95 * count) AS i, max(le) AS top FROM w GROUP BY method)
SELECT w.method, CASE WHEN w.le IS NULL THEN h.top::DOUBLE ELSE w.lo + (w.le - w.lo) * ((0.95 * count - ln)::DOUBLE / (n - ln)) END::DOUBLE AS quantile FROM w JOIN h USING (method, i)"""
)
def histogram_quantile(spark, sf):
    return timeseries.histogram_quantile(rpc_latency_histogram(spark, sf), 0.95, ["method"])


_DELTA = "dl AS (SELECT *, CASE WHEN lag(value) OVER o IS NULL THEN NULL WHEN value < lag(value) OVER o THEN value ELSE value - lag(value) OVER o END AS delta FROM samples WINDOW o AS (PARTITION BY name, event ORDER BY ts))"
_INC = f"inc AS (SELECT name, event, ts, value, coalesce(sum(delta) OVER (PARTITION BY name, event ORDER BY ts RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW), 0) AS increase FROM dl)"


@register(f"WITH {COUNTER_SQL}, {_DELTA}, {_INC} SELECT * FROM inc")
def counter_increase(spark, sf):
    return timeseries.increase(fx.counter_samples(spark, sf), ["name", "event"], 6 * HOUR).select("name", "event", "ts", "value", "increase")


@register(f"WITH {COUNTER_SQL}, {_DELTA}, {_INC} SELECT name, event, ts, value, increase / {6 * 3600.0} AS rate FROM inc")
def counter_rate(spark, sf):
    return timeseries.rate(fx.counter_samples(spark, sf), ["name", "event"], 6 * HOUR).select("name", "event", "ts", "value", "rate")


@register(f"WITH {COUNTER_SQL}, {_DELTA}, {_INC} SELECT name, ts, coalesce(sum(increase / 21600.0) FILTER (event = 'failed'), 0) / greatest(coalesce(sum(increase / 21600.0) FILTER (event IN ('completed', 'failed')), 0), 0.001) AS failure_ratio FROM inc GROUP BY name, ts")
def failure_ratio(spark, sf):
    return timeseries.failure_ratio(fx.counter_samples(spark, sf), 6 * HOUR)


_GAUGE = f"{LIFECYCLE_SQL}, g AS (SELECT name, ts // {HOUR} * {HOUR} AS ts, sum(CASE event WHEN 'enqueued' THEN 1.0::DOUBLE WHEN 'completed' THEN -1.0 ELSE 0.0 END) AS d FROM lifecycle_events GROUP BY ALL), gauge AS (SELECT name, ts, sum(d) OVER (PARTITION BY name ORDER BY ts) AS value FROM g)"


def _gauge(spark, sf):
    e = fx.lifecycle_events(spark, sf)
    d = F.when(F.col("event") == "enqueued", 1.0).when(F.col("event") == "completed", -1.0).otherwise(0.0)
    g = e.groupBy("name", F.expr(f"ts div {HOUR} * {HOUR}").alias("ts")).agg(F.sum(d).alias("d"))
    return g.select("name", "ts", F.sum("d").over(Window.partitionBy("name").orderBy("ts")).alias("value"))


_DERIV = f"dv AS (SELECT name, ts, value, CASE WHEN count(*) OVER o > 1 THEN regr_slope(value, ts / 1000.0) OVER o END AS deriv FROM gauge WINDOW o AS (PARTITION BY name ORDER BY ts RANGE BETWEEN {12 * HOUR - 1} PRECEDING AND CURRENT ROW))"


@register(f"WITH {_GAUGE}, {_DERIV} SELECT name, ts, value, round(deriv, 7) AS deriv FROM dv")
def backlog_deriv(spark, sf):
    return timeseries.deriv(_gauge(spark, sf), ["name"], 12 * HOUR).withColumn("deriv", F.round("deriv", 7))


@register(
    f"""WITH {_GAUGE}, h AS (SELECT *, value > lag(value, 1, 0) OVER (PARTITION BY name ORDER BY ts) AS holds FROM gauge),
i AS (SELECT *, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY name ORDER BY ts) AS breaks FROM h),
s AS (SELECT *, min(ts) FILTER (holds) OVER (PARTITION BY name, breaks) AS since FROM i)
SELECT name, ts, coalesce(holds AND ts - since >= {3 * HOUR}, false) AS firing FROM s"""
)
def alerts_firing(spark, sf):
    g = _gauge(spark, sf)
    before = F.coalesce(F.lag("value").over(Window.partitionBy("name").orderBy("ts")), F.lit(0.0))
    return timeseries.alert(g.withColumn("grows", F.col("value") > before), F.col("grows"), 3 * HOUR, ["name"]).select("name", "ts", "firing")


# a minute of the evaluations is an hour of events
_PRESSURE = f"""{LIFECYCLE_SQL}, m AS (SELECT name, (ts // 60) // 60000 * 60000 + 60000 AS ts, max(ts // 60) AS sample_ts, count(*) * 30 AS oldest_due_age_s, sum(CASE event WHEN 'enqueued' THEN 200 WHEN 'completed' THEN -100 ELSE 0 END) AS d, count(*) FILTER (event = 'failed') AS expired_leases, count(*) FILTER (event = 'retried') AS r FROM lifecycle_events GROUP BY 1, 2),
p AS (SELECT *, sum(d) OVER o AS due, sum(r) OVER o AS recovery_errors FROM m WINDOW o AS (PARTITION BY name ORDER BY ts)),
q AS (SELECT *, ts / 1000 - sample_ts / 1000 AS age, CASE WHEN count(*) OVER t > 1 THEN regr_slope(due, ts / 1000) OVER t END AS growth, recovery_errors - lag(recovery_errors) OVER (PARTITION BY name ORDER BY ts) AS delta FROM p WINDOW t AS (PARTITION BY name ORDER BY ts RANGE BETWEEN 599999 PRECEDING AND CURRENT ROW)),
rules AS (SELECT name, ts, unnest([{{'alert': 'sample_stale', 'for_ms': 60000, 'holds': age > 30}}, {{'alert': 'due_aging', 'for_ms': 300000, 'holds': oldest_due_age_s > 60 AND age < 30}}, {{'alert': 'backlog_growing', 'for_ms': 600000, 'holds': growth > 1 AND age < 30}},
  {{'alert': 'expired_claims', 'for_ms': 120000, 'holds': expired_leases > 0 AND age < 30}}, {{'alert': 'recovery_errors', 'for_ms': 0, 'holds': coalesce(sum(delta) OVER (PARTITION BY name ORDER BY ts RANGE BETWEEN 299999 PRECEDING AND CURRENT ROW), 0) > 0}}]) AS c FROM q),
e AS (SELECT name, ts, c.alert AS alert, c.for_ms AS for_ms, coalesce(c.holds, false) AS holds FROM rules),
i AS (SELECT *, sum((NOT holds)::INTEGER) OVER (PARTITION BY name, alert ORDER BY ts) AS breaks FROM e)"""


@register(f"WITH {_PRESSURE} SELECT name, ts, alert FROM (SELECT *, min(ts) FILTER (holds) OVER (PARTITION BY name, alert, breaks) AS since FROM i) WHERE holds AND ts - since >= for_ms")
def alert_rules(spark, sf):
    e = fx.lifecycle_events(spark, sf).withColumn("t", F.expr("ts div 60"))
    net = F.when(F.col("event") == "enqueued", 200).when(F.col("event") == "completed", -100).otherwise(0)
    count_if = lambda k: F.count(F.when(F.col("event") == k, 1))
    m = e.groupBy("name", F.expr("t div 60000 * 60000 + 60000").alias("ts")).agg(F.max("t").alias("sample_ts"), (F.count("*") * 30).alias("oldest_due_age_s"), F.sum(net).alias("d"), count_if("failed").alias("expired_leases"), count_if("retried").alias("r"))
    w = Window.partitionBy("name").orderBy("ts")
    return timeseries.pressure_alerts(m.withColumns({"due": F.sum("d").over(w), "recovery_errors": F.sum("r").over(w)}), ["name"])


@register(f"WITH {LIFECYCLE_SQL}, c AS (SELECT name, event, count(*)::DOUBLE AS value FROM lifecycle_events WHERE NOT (name = 'q3' AND event = 'failed') GROUP BY ALL) SELECT name, max(value) FILTER (event = 'enqueued') AS enqueued, max(value) FILTER (event = 'completed') AS completed, max(value) FILTER (event = 'failed') AS failed FROM c GROUP BY name")
def function_overview(spark, sf):
    c = metrics.event_counts(fx.lifecycle_events(spark, sf).where("not (name = 'q3' and event = 'failed')")).withColumn("value", F.col("n").cast("double"))
    return timeseries.overview({e: c.where(F.col("event") == e) for e in ("enqueued", "completed", "failed")})


@register(f"WITH {LIFECYCLE_SQL} SELECT name, event, count(*) AS n FROM lifecycle_events GROUP BY ALL")
def event_counters(spark, sf):
    return metrics.event_counts(fx.lifecycle_events(spark, sf))


_TRANSITIONS = f"""{LIFECYCLE_SQL}, log AS (SELECT name, CASE event WHEN 'retried' THEN 'lease_expired' ELSE event END AS event, event_id % 3 = 0 AS again FROM lifecycle_events),
every AS (SELECT event FROM log UNION ALL SELECT 'retried' FROM log WHERE again AND event IN ('failed', 'lease_expired')),
named AS (SELECT name, CASE WHEN event NOT IN ('failed', 'lease_expired') THEN event WHEN again THEN 'retried' ELSE 'failed' END AS event FROM log)"""


@register(f"WITH {_TRANSITIONS} SELECT NULL AS name, k.event, count(e.event) AS n FROM (VALUES ('enqueued'), ('claimed'), ('completed'), ('failed'), ('retried'), ('lease_expired')) k(event) LEFT JOIN every e ON e.event = k.event GROUP BY k.event UNION ALL SELECT name, event, count(*) FROM named GROUP BY name, event")
def transition_counts(spark, sf):
    e = fx.lifecycle_events(spark, sf)
    log = e.select("name", F.when(F.col("event") == "retried", "lease_expired").otherwise(F.col("event")).alias("event"), (F.col("event_id") % 3 == 0).alias("retried"))
    return metrics.transition_counts(log)


@register(
    "WITH b AS (" + _hist_sql("SELECT event_type AS method, floor(value * 1000)::BIGINT AS v FROM events", metrics.RPC_BOUNDS, "method", 1e6) + """)
SELECT 'rpc_bucket{method="' || method || '",le="' || CASE WHEN le IS NULL THEN '+Inf' WHEN le % 1000000 = 0 THEN (le // 1000000)::VARCHAR ELSE rtrim((le / 1000000)::DECIMAL(30, 6)::VARCHAR, '0') END || '"} ' || n AS line FROM b
UNION ALL SELECT 'rpc_count{method="' || method || '"} ' || count FROM b WHERE le IS NULL
UNION ALL SELECT 'rpc_sum{method="' || method || '"} ' || rtrim(rtrim(round(total, 6)::DECIMAL(30, 6)::VARCHAR, '0'), '.') FROM b WHERE le IS NULL"""
)
def histogram_exposition(spark, sf):
    return metrics.histogram_lines(rpc_latency_histogram(spark, sf), "rpc", "method")


_CLIENT_VALUES = {"processed": "event_id % 1000", "failed": "event_id % 7", "retried": "event_id % 5", "poll_failures": "event_id % 3", "reconnects": "user_id % 4", "active": "user_id % 11", "connection_up": "event_id % 2"}


@register(" UNION ALL ".join(f"""SELECT '{s}' AS series, '{kind}' AS kind, 'c_{s}{{queue="' || event_type || '",worker="w\\"' || user_id || '"}} ' || ({_CLIENT_VALUES[c]}) AS line FROM events""" for s, (kind, c) in metrics.CLIENT_SERIES.items()))
def client_metrics(spark, sf):
    e = fx.load(spark, sf, "events")
    c = e.select(F.col("event_type").alias("queue"), F.concat(F.lit('w"'), F.col("user_id").cast("string")).alias("worker"), *(F.expr(x).alias(n) for n, x in _CLIENT_VALUES.items()))
    return metrics.client_lines(c, "c_", ["queue", "worker"])


@register(f"WITH {LIFECYCLE_SQL}, s AS (SELECT name, count(*) AS n, min(ts) AS t, arg_min(event_id, ts::HUGEINT * 100000000 + event_id) AS e FROM lifecycle_events GROUP BY name), r AS (SELECT *, row_number() OVER (ORDER BY CASE name WHEN 'q6' THEN 0 WHEN 'q2' THEN 1 ELSE 2 END, t, e) AS k FROM s) SELECT CASE WHEN k <= 5 THEN name END AS name, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def bounded_series(spark, sf):
    return metrics.bounded_names(fx.lifecycle_events(spark, sf), 5, ("q6", "q2"))


@register(_j("""SELECT '# TYPE jobs gauge' AS line UNION ALL SELECT 'jobs{state="' || state || '"} ' || n FROM (SELECT state, count(*) AS n FROM job_all GROUP BY state)"""))
def metrics_exposition(spark, sf):
    return metrics.exposition(state_counts(spark, sf), "jobs", ["state"], "jobs")


# ---- load reports


@register(_j("SELECT name, quantile_disc(d, 0.5)::DOUBLE AS p50, quantile_disc(d, 0.95)::DOUBLE AS p95, quantile_disc(d, 0.99)::DOUBLE AS p99, avg(d) AS mean, max(d)::DOUBLE AS max FROM (SELECT name, finished_at - created_at AS d FROM job_history) GROUP BY name"))
def load_percentiles(spark, sf):
    h = fx.job_history(spark, sf).withColumn("d", F.col("finished_at") - F.col("created_at"))
    return loadreport.percentiles(h, "d", ["name"])


@register(f"WITH {_GAUGE} SELECT name, round(coalesce(regr_slope(value, (ts - 1704067200000) / 3600000.0), 0), 6) AS slope FROM gauge GROUP BY name")
def backlog_slope(spark, sf):
    g = _gauge(spark, sf).withColumn("x", (F.col("ts") - 1_704_067_200_000) / 3_600_000.0)
    return loadreport.slope(g, "x", "value", ["name"]).withColumn("slope", F.round("slope", 6))


#: Fixed values of a published load report: target rate, repetition, enqueue and completion rate, slope.
RUNS = [
    (200, 1, 200.0, 199.98, 0.0), (200, 2, 200.0, 199.97, -0.01), (200, 3, 200.0, 199.98, 0.0),
    (350, 1, 350.0, 349.95, -0.13), (350, 2, 350.0, 349.9, -0.1), (350, 3, 350.0, 349.95, 0.2),
    (400, 1, 232.42, 114.48, 116.11), (400, 2, 240.0, 110.0, 120.0), (400, 3, 230.0, 118.0, 110.0),
    (250, 1, 250.0, 248.27, 0.4), (250, 2, 250.0, 86.68, 150.0), (250, 3, 250.0, 249.97, 0.0),
]
_RUNS = "runs(target_rate, rep, enqueue_rate, completion_rate, slope) AS (VALUES " + ", ".join(f"({a}::INTEGER, {b}::INTEGER, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)" for a, b, c, d, e in RUNS) + "), v AS (SELECT *, slope <= 2 AND completion_rate >= 0.98 * enqueue_rate AS sustained FROM runs)"
_CELLS = "cells AS (SELECT target_rate, median(completion_rate) AS median, min(completion_rate) AS min, max(completion_rate) AS max, count(*) AS reps, count(*) FILTER (sustained) AS held FROM v GROUP BY target_rate)"


def _runs(spark):
    r = spark.createDataFrame(RUNS, "target_rate int, rep int, enqueue_rate double, completion_rate double, slope double")
    return loadreport.verdict(r.withColumn("errors", F.lit(0)))


@register(f"WITH {_RUNS} SELECT target_rate, rep, sustained FROM v")
def sustained_verdict(spark, sf):
    return _runs(spark).select("target_rate", "rep", "sustained")


@register(f"WITH {_RUNS}, {_CELLS} SELECT *, max / min AS spread, max / min <= 1.5 AS reproducible, 2 * held >= reps AS sustained FROM cells")
def rep_summary(spark, sf):
    return loadreport.summarize(_runs(spark), ["target_rate"])


@register(f"WITH {_RUNS}, {_CELLS}, s AS (SELECT *, 2 * held >= reps AS ok FROM cells), l AS (SELECT max(target_rate) FILTER (ok) AS low FROM s) SELECT low, (SELECT min(target_rate) FROM s, l WHERE NOT ok AND target_rate > low) AS high FROM l")
def sustainable_bracket(spark, sf):
    return loadreport.bracket(loadreport.summarize(_runs(spark), ["target_rate"]))


# ---- schedulers, upserts, outbox, flows

SCHEDULERS = [("s1", "report", "0 3 * * *", None, 0), ("s2", "report", "30 2 * * *", "America/Denver", 1_710_054_000_000), ("s3", "sync", "*/15 * * * *", "Europe/Berlin", 1_704_067_199_999), ("s4", "sync", "bad cron", None, 5), ("s5", "late", "0 0 1 1 *", "UTC", 1_900_000_000_000), ("s6", "tz", "0 0 * * *", "No/Where", 7)]


def _schedulers(spark):
    rows = [(i, n, c, z, 3, t, "old", 10, 20) for i, n, c, z, t in SCHEDULERS]
    s = spark.createDataFrame(rows, "id string, job_name string, cron string, timezone string, produced_count long, next_run_at long, last_job_id string, created_at long, updated_at long")
    return s.withColumns({"max_attempts": F.lit(3), "rate_limit_facet": F.concat(F.lit("tenant:"), "job_name"), "payload": F.lit("{}").cast("binary"), "priority": F.lit(None).cast("int"), "retry_jitter": F.lit(0.0), "retry_backoff_ms": F.lit(0), "retry_backoff_max_ms": F.lit(0)})


@register()
def cron_next(spark, sf):
    from jobloom.functions import cron

    return _schedulers(spark).select("id", cron.next_run(F.col("cron"), F.col("timezone"), F.col("next_run_at")).alias("next_run_at"), cron.problem(F.col("cron"), F.col("timezone")).alias("error"))


_DUE_AT = 1_710_100_000_000


@register("SELECT id, next_run_at FROM (VALUES " + ", ".join(f"('{i}', {t}::BIGINT)" for i, _, _, _, t in SCHEDULERS) + f") s(id, next_run_at) WHERE next_run_at <= {_DUE_AT}")
def due_schedulers(spark, sf):
    return schedulers.due(_schedulers(spark), _DUE_AT).select("id", "next_run_at")


@register()
def scheduler_fire(spark, sf):
    jobs, after = schedulers.fire(_schedulers(spark), _DUE_AT)
    return after.join(jobs.select(F.col("scheduler_id").alias("id"), F.col("id").alias("job_id")), "id", "left").select("id", "next_run_at", "produced_count", "last_job_id", "job_id")


@register(
    _j(
        "SELECT coalesce(c.trace_id, n.trace_id) AS trace_id, coalesce(c.job_count, 0) + coalesce(n.n, 0) AS job_count FROM (SELECT trace_id, count(*) AS job_count FROM jobs GROUP BY trace_id) c FULL JOIN (SELECT 'trace-' || (user_id % 120) AS trace_id, count(*) AS n FROM events GROUP BY ALL) n ON c.trace_id = n.trace_id"
    )
)
def upsert_counters(spark, sf):
    have = fx.jobs(spark, sf).groupBy("trace_id").agg(F.count("*").alias("job_count"))
    new = fx.load(spark, sf, "events").groupBy(F.concat(F.lit("trace-"), (F.col("user_id") % 120).cast("string")).alias("trace_id")).agg(F.count("*").alias("n"))
    changes = new.join(have, "trace_id", "left").select("trace_id", (F.coalesce("job_count", F.lit(0)) + F.col("n")).alias("job_count"))
    return limits.upsert(have, changes, ["trace_id"])


@register(f"WITH {REQUESTS_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY t_ms, seq) AS rn FROM requests) SELECT idempotency_key AS key, seq, CASE WHEN seq % 3 = 0 THEN 'sent' WHEN seq % 3 = 1 THEN 'pending' ELSE 'failed' END AS state FROM d WHERE rn = 1 ORDER BY t_ms, seq LIMIT 32")
def outbox_drain(spark, sf):
    from jobloom.sources import outbox

    r = fx.requests(spark, sf).select(F.col("idempotency_key").alias("key"), F.col("t_ms").alias("created_at"), "seq", F.lit("pending").alias("state"))
    batch = outbox.next_batch(outbox.first_writer_wins(r, ["created_at", "seq"]), ["created_at", "seq"])
    answers = batch.select("key", F.when(F.col("seq") % 3 == 0, "ok").when(F.col("seq") % 3 == 1, "unavailable").otherwise("invalid").alias("answer"))
    return outbox.settle(batch, answers).select("key", "seq", "state")


@register(
    _j(
        """SELECT flow_no, count(*) AS nodes, max(depth) AS height, CASE WHEN count(*) > 1000 THEN 'too many nodes' WHEN count(*) FILTER (depth IS NULL) > 0 THEN 'too high' END AS error
FROM (SELECT root::BIGINT AS flow_no, CASE WHEN depth <= 5 THEN depth END AS depth FROM depths) GROUP BY flow_no""",
        _DEPTHS,
    )
)
def flow_validate(spark, sf):
    d = flows.depths(fx.job_all(spark, sf), max_height=12)
    nodes = d.join(fx.job_all(spark, sf).select("id", "parent_id", "name"), "id").select(F.col("root").cast("long").alias("flow_no"), F.col("id").alias("node_no"), F.col("parent_id").alias("parent_node_no"), "name", F.lit(None).cast("string").alias("idempotency_key"))
    return flows.validate_flows(nodes, max_height=5)


@register(
    _j(
        """SELECT t.id AS target_id, CASE WHEN j.state IS NULL THEN 'not live' WHEN j.state = 'Active' THEN 'active' WHEN j.depth + 2 > 8 THEN 'too high' WHEN have + 3 > 400 THEN 'too many nodes' END AS error
FROM (SELECT id FROM job_all) t LEFT JOIN (SELECT jobs.id, state, depth, root FROM jobs JOIN depths USING (id)) j ON t.id = j.id LEFT JOIN (SELECT root, count(*) AS have FROM jobs JOIN depths USING (id) GROUP BY root) h ON h.root = j.root""",
        _DEPTHS,
    )
)
def flow_merge(spark, sf):
    d = flows.depths(fx.job_all(spark, sf), max_height=12).where("depth is not null")
    live = fx.jobs(spark, sf).join(d, "id").select("id", "state", F.col("root").alias("tree_id"), F.col("depth").alias("tree_depth"))
    targets = fx.job_all(spark, sf).select(F.col("id").alias("target_id"))
    added = targets.select("target_id", F.explode(F.array(F.lit(1), F.lit(1), F.lit(2))).alias("rel_depth"))
    return flows.validate_merge(targets, live, added, max_height=8, max_nodes=400)


@register(_j("SELECT id AS parent_id, child, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INTEGER AS index, id || ':' || child || ':' || (i - 1) AS idempotency_key FROM (SELECT id, unnest(['parse', 'store']) AS child, generate_subscripts(['parse', 'store'], 1) AS i FROM jobs WHERE state = 'Active')"))
def child_fan_out(spark, sf):
    parents = fx.jobs(spark, sf).where("state = 'Active'").select(F.col("id").alias("parent_id"), F.array(F.lit("parse"), F.lit("store")).alias("children"))
    return flows.fan_out_keys(parents)


# ---- clients


@register("WITH c AS (SELECT event_type AS queue, value < 300 AS connected, user_id % 97 = 0 AS draining, event_id % 5 AS completed, event_id % 3 AS failed, value AS last_ms FROM events) SELECT queue, bool_and(connected) AS all_connected, bool_or(draining) AS any_draining, sum(completed)::BIGINT AS completed, sum(failed)::BIGINT AS failed, max(last_ms) AS worst_ms, min(connected::INTEGER) AS connection_up FROM c GROUP BY queue")
def client_fleet(spark, sf):
    e = fx.load(spark, sf, "events")
    c = e.select(F.col("event_type").alias("queue"), (F.col("value") < 300).alias("connected"), (F.col("user_id") % 97 == 0).alias("draining"), (F.col("event_id") % 5).alias("completed"), (F.col("event_id") % 3).alias("failed"), F.col("value").alias("last_ms"))
    return client.fleet(c, ["queue"])


@register(f"WITH c AS (SELECT user_id, max(epoch_us(ts) // 1000) AS last_seen, bool_or(event_type = 'purchase') AS connected, bool_or(value > 150) AS draining FROM events GROUP BY user_id) SELECT user_id, last_seen > {1_706_659_200_000 - 6 * HOUR} AS live, last_seen > {1_706_659_200_000 - 6 * HOUR} AND connected AND NOT draining AS ready FROM c")
def client_health(spark, sf):
    e = fx.load(spark, sf, "events")
    c = e.groupBy("user_id").agg(F.max(fx.epoch_ms("ts")).alias("last_seen"), F.some(F.col("event_type") == "purchase").alias("connected"), F.some(F.col("value") > 150).alias("draining"))
    return client.health(c, 1_706_659_200_000, 6 * HOUR).select("user_id", "live", "ready")


@register("WITH b AS (SELECT event_id, event_id // 25 AS batch_id, event_id % 25 AS pos, CASE WHEN value > 200 THEN 'too large' END AS error FROM events), f AS (SELECT *, min(pos) FILTER (error IS NOT NULL) OVER (PARTITION BY batch_id) AS bad FROM b) SELECT event_id, coalesce(pos > bad, false) AS skipped, error IS NULL AND NOT coalesce(pos > bad, false) AS ok, CASE WHEN NOT coalesce(pos > bad, false) THEN error END AS error FROM f")
def client_bulk_results(spark, sf):
    e = fx.load(spark, sf, "events")
    b = e.select("event_id", F.expr("event_id div 25").alias("batch_id"), (F.col("event_id") % 25).alias("pos"), F.when(F.col("value") > 200, "too large").alias("error"))
    return client.bulk_results(b, stop_on_error=True).select("event_id", "skipped", "ok", "error")


@register("SELECT event_id, 'level=warn ' || event_type || ' enqueue rejected' AS line FROM events WHERE event_type = 'error'")
def log_filter(spark, sf):
    e = fx.load(spark, sf, "events")
    logs = e.select("event_id", F.concat(F.lit("level=warn "), "event_type", F.when(F.col("event_type") == "error", " enqueue rejected").otherwise(" enqueue accepted")).alias("line"))
    return client.log_lines(logs, "enqueue rejected")


@register(f"WITH {LIFECYCLE_SQL} SELECT name, event, 1706745600000 - max(ts) AS age_ms FROM lifecycle_events GROUP BY ALL")
def series_staleness(spark, sf):
    return client.staleness(fx.lifecycle_events(spark, sf), F.lit(1_706_745_600_000), ["name", "event"])


_NULL = "NULL"
_LISTED = "SELECT id, job_name, '{}' AS payload, cron, timezone, 3::BIGINT AS produced_count, next_run_at, 'old' AS last_job_id, NULL::INTEGER AS priority, 3 AS max_attempts, 0 AS retry_backoff_ms, 0 AS retry_backoff_max_ms, 0.0::DOUBLE AS retry_jitter, 'tenant:' || job_name AS rate_limit_facet, 10::BIGINT AS created_at, 20::BIGINT AS updated_at FROM (VALUES " + ", ".join(f"('{i}', '{n}', '{c}', {_NULL if z is None else repr(z)}, {t}::BIGINT)" for i, n, c, z, t in SCHEDULERS) + ") s(id, job_name, cron, timezone, next_run_at)"


@register(_LISTED + " ORDER BY id")
def scheduler_list(spark, sf):
    return search.scheduler_list(_schedulers(spark)).withColumn("payload", F.col("payload").cast("string"))


@register(_LISTED + " WHERE id = 's2'")
def scheduler_get(spark, sf):
    return search.scheduler_list(_schedulers(spark), "s2").withColumn("payload", F.col("payload").cast("string"))


@register(_j("SELECT facet_key, last_served_seq FROM facet_dispatch WHERE facet_key <> 'tenant:furniture' UNION ALL SELECT 'tenant:furniture', (SELECT max(last_served_seq) + 1 FROM facet_dispatch)", RULES_SQL))
def record_turn(spark, sf):
    served = fx.rate_rules(spark)[2]
    turn = served.agg((F.max("last_served_seq") + 1).alias("last_served_seq")).select(F.lit("tenant:furniture").alias("facet_key"), "last_served_seq", F.lit(NOW_MS).alias("last_served_at"))
    return limits.upsert(served, turn, ["facet_key"]).select("facet_key", "last_served_seq")


# ---- streams: the same questions, asked of a stream that is drained


def _stream(spark, sf, shape, apply, name, mode="append"):
    from jobloom.sources.paths import shared_path
    from jobloom.streaming import wiring

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return wiring.drain(apply(shape(wiring.table_stream(spark, sf, "events"))), shared_path(spark, name), mode)


def _request_shape(e):
    return e.select(F.col("event_id").alias("seq"), fx.epoch_ms("ts").alias("t_ms"), F.col("event_type").alias("name"), F.col("event_type").alias("facet"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("idempotency_key"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("trace_id"), F.col("props").alias("request"))


@register(ORACLES["ingress_admission"])
def stream_ingress_admission(spark, sf):
    from jobloom.streaming import state

    return _stream(spark, sf, _request_shape, lambda r: state.sliding_admission(r.select("seq", "t_ms", "facet"), INGRESS_LIMIT, INGRESS_WINDOW), "ingress")


@register(ORACLES["dedup_receipts"])
def stream_dedup_receipts(spark, sf):
    from jobloom.streaming import state

    return _stream(spark, sf, _request_shape, lambda r: state.dedup_receipts(r.select("seq", "t_ms", "name", "idempotency_key", "request")), "receipts")


@register(ORACLES["chain_quarantine"])
def stream_chain_quarantine(spark, sf):
    from jobloom.streaming import state

    return _stream(spark, sf, _request_shape, lambda r: state.chain_quarantine(r.select("seq", "t_ms", "trace_id"), 25), "chain")


@register(ORACLES["event_counters"])
def stream_event_counters(spark, sf):
    def shape(e):
        event = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in fx.EVENT_OF.items()))
        return e.select(F.concat(F.lit("q"), (F.col("user_id") % 8).cast("string")).alias("name"), event.alias("event"))

    return _stream(spark, sf, shape, metrics.event_counts, "counters", "complete")


@register(ORACLES["fixed_window_claims"])
def stream_fixed_window_claims(spark, sf):
    from jobloom.streaming import state

    return _stream(spark, sf, _request_shape, lambda r: state.fixed_window_admission(r.select("seq", "t_ms", "facet"), INGRESS_LIMIT, INGRESS_WINDOW), "fixed")
