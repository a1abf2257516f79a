"""Expected results on small tables."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobloom import schemas
from jobloom.functions import cron, scheduling, text
from jobloom.operators import admission, dispatch, flows, lifecycle, limits, loadreport, metrics, retention, schedulers, search, timeseries
from jobloom.operators.limits import SlidingBucket
from jobloom.plans import queries as q
from jobloom.sources import fixtures as fx
from jobloom.sources import outbox, store, workload


def df(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def ms(text_):
    return int(dt.datetime.fromisoformat(text_).timestamp() * 1000)


def test_backlog_sample(spark):
    jobs = df(spark, [("email", "Waiting", 1000, 500, None), ("email", "Delayed", 9000, 500, None), ("email", "Delayed", None, 500, None), ("other", "Delayed", 2000, 500, None), ("other", "Active", None, 500, 4000), ("other", "Active", None, 500, 9000)], "name string, state string, available_at long, created_at long, lease_expires_at_ms long")
    got = {r.name: r for r in metrics.backlog_allowed(jobs, 5000, ["email", "empty"]).collect()}
    t = got[None]
    assert (t.waiting, t.delayed, t.active, t.due, t.unscheduled, t.expired_leases, t.oldest_due_age_ms) == (1, 3, 2, 2, 1, 1, 4000)
    assert got["email"].due == 1 and got["empty"].due == 0 and set(got) == {"email", "empty", None}
    none = metrics.backlog_allowed(jobs.limit(0), 5000, ["email"]).collect()
    assert all(r.waiting == r.due == r.oldest_due_age_ms == 0 for r in none) and len(none) == 2


def test_claim_histograms(spark):
    c = df(spark, [(1000, 5000, 6000, 1), (1000, 10000, 10500, 2), (12000, 12000, 11000, 1)], "created_at long, available_at long, claimed_at long, attempts int")
    first = metrics.histogram(c, metrics.claim_delay(c), metrics.DELAY_BOUNDS).collect()
    due = {r.le: r for r in metrics.histogram(c, metrics.due_wait(c), metrics.DELAY_BOUNDS).collect()}
    assert first[0]["count"] == 2 and first[0].total == 5.0
    assert due[None].n == 3 and due[None].total == 1.5 and due[1000].n == 3


def test_sliding_bucket():
    b = SlidingBucket(0, 7, 42).rolled(1500, 1000)
    assert (b.start, b.current, b.previous) == (1000, 0, 7) and b.estimate(1000, 1000) == 7.0
    b = SlidingBucket(0, 9, 9).rolled(2500, 1000)
    assert (b.start, b.current, b.previous) == (2000, 0, 0)


@pytest.mark.parametrize(("limit", "times", "want"), [(3, [0, 10, 20, 30], [True, True, True, False]), (1, [0, 500, 2000], [True, False, True]), (0, [0, 1], [False, False])])
def test_sliding_admission(spark, limit, times, want):
    r = df(spark, [(i, t, "f") for i, t in enumerate(times)], "seq long, t_ms long, facet string")
    assert [x.admitted for x in limits.sliding_admission(r, limit, 1000).orderBy("seq").collect()] == want
    ruled = r.withColumns({"max_jobs": F.lit(None).cast("long"), "window_duration_ms": F.lit(None).cast("long")})
    assert all(x.admitted for x in limits.sliding_admission(ruled).collect())


def test_fixed_window(spark):
    r = df(spark, [(i, t, "f") for i, t in enumerate([0, 10, 20, 1000, 1001])], "seq long, t_ms long, facet string")
    assert [x.admitted for x in limits.fixed_window_admission(r, 2, 1000).orderBy("seq").collect()] == [True, True, False, True, True]


def test_failures_feed(spark):
    h = df(spark, [("f1", "email", "Failed", 3, 100), ("f2", "email", "Failed", 5, 300), ("f3", "sms", "Failed", 2, 200), ("c1", "email", "Completed", 1, 400)], "id string, name string, state string, attempts int, finished_at long")
    ids = lambda **k: [r.id for r in search.failures(h, **k).collect()]
    assert ids() == ["f2", "f3", "f1"] and ids(name="email") == ["f2", "f1"] and ids(since_ms=200) == ["f2", "f3"] and ids(limit=1) == ["f2"]


HISTORY = "id string, name string, state string, trace_id string, last_error string, finished_at long"


def test_search_like(spark):
    h = df(spark, [("job-alpha", "email", "Failed", "trace-1", "timeout talking to smtp", 100), ("job-beta", "sms", "Completed", "trace-2", None, 200), ("gamma-id", "email", "Failed", "alpha-trace", "boom", 300)], HISTORY)
    ids = lambda **k: [r.id for r in search.search(h, **k).collect()]
    assert ids(q="ALPHA") == ["gamma-id", "job-alpha"] and ids(q="smtp") == ["job-alpha"]
    with pytest.raises(ValueError):
        search.search(h, q="  ")


def test_search_escapes(spark):
    h = df(spark, [("id-100pct", "a", "Failed", "t", "100% failure", 1), ("id-plain", "a", "Failed", "t", "50 percent", 2), ("id_under", "a", "Failed", "t", "has_underscore", 3), ("idXunder", "a", "Failed", "t", "noUnderscore", 4)], HISTORY)
    ids = lambda q: [r.id for r in search.search(h, q=q).collect()]
    assert ids("100%") == ["id-100pct"] and ids("id_under") == ["id_under"] and ids("\\") == []


def test_full_text(spark):
    h = df(spark, [("a", "upstream", "Failed", "t1", "timeout talking to smtp", 1), ("b", "upstreamer", "Failed", "t2", "connection refused by smtp", 2), ("c", "downstream", "Completed", "t3", "Café-Über fermé", 3), ("d", "x", "Failed", "t4", "connection to upstream", 4)], HISTORY)
    ids = lambda q, **k: sorted(r.id for r in search.search(h, q=q, full_text=True, **k).collect())
    assert ids("upstrea*") == ["a", "b", "d"] and ids("upstream") == ["a", "d"] and ids("upstrea") == []
    assert ids("connection upstrea*") == ["b", "d"] and ids("smtp", state="Completed") == [] and ids("smtp", name="upstreamer", state="Failed", since_ms=2) == ["b"]
    assert ids("cafe") == ["c"] and ids("uber ferme") == ["c"] and ids("*") == [] and ids('"*') == [] and ids("(((") == [] and ids("((( smtp") == ["a", "b"]


def test_query_parser():
    assert text.parse_query("upstrea*") == [("upstrea", True)] and text.parse_query("foo") == [("foo", False)]
    assert text.parse_query("*") == [] == text.parse_query("**") and text.parse_query("foo*bar") == [("foo*bar", False)] and text.parse_query("word**") == [("word", True)]
    assert text.parse_query("connection upstrea*") == [("connection", False), ("upstrea", True)]
    assert text.truthy("Yes") and not text.truthy("on")


def test_blob_and_labels(spark):
    rows = df(spark, [(bytearray(b'{"a": 1}'),), (bytearray(b"\xff\x00"),), (bytearray(b"x" * 100),), (None,)], "b binary")
    value, kind = text.blob_view(F.col("b"))
    got = [(r[0], r[1]) for r in rows.select(value, kind).collect()]
    assert got[0] == ('{"a": 1}', "json") and got[1] == ("/wA=", "base64") and "\n" not in got[2][0] and got[3] == (None, None)
    lines = [r.line for r in metrics.exposition(df(spark, [('q"1\\', 2)], "name string, value long"), "m", ["name"]).collect()]
    assert lines == ["# TYPE m gauge", 'm{name="q\\"1\\\\"} 2']


def test_retention(spark):
    h = df(spark, [(f"A-{i}", "A", "Completed", 1000 - i) for i in range(4)] + [("B", "B", "Completed", 900)], "id string, name string, state string, finished_at long")
    assert sorted(r.id for r in retention.by_count(h, "Completed", 1).collect()) == ["A-1", "A-2", "A-3"]
    old = df(spark, [(f"o{i}", "n", "Failed", i) for i in range(5)] + [("new", "n", "Failed", 10**9)], "id string, name string, state string, finished_at long")
    left, sizes = old, []
    for _ in range(4):
        gone = retention.by_age(left, "Failed", 10**9, 60_000, batch=2)
        sizes.append(gone.count())
        left = left.join(gone.select("id"), "id", "left_anti")
    assert sizes == [2, 2, 1, 0] and retention.effective_age(1) == 60_000
    receipts = df(spark, [("q", "k1", "live", 0), ("q", "k2", "done", 0), ("q", "k3", "gone", 0), ("q", "k4", "gone", 10**9)], "queue_name string, idempotency_key string, job_id string, created_at long")
    ids = lambda *x: df(spark, [(i,) for i in x], "id string")
    assert [r.idempotency_key for r in retention.receipts(receipts, ids("live"), ids("done"), 10**9, 1000).collect()] == ["k3"]


def brute_fair(jobs, seed):
    """Claim after claim, as the rotation says."""
    left, last, out, n = list(jobs), dict(seed), [], max([0, *seed.values()])
    while left:
        best = min(left, key=lambda j: (j[1], last.get(j[2] or "", 0), j[3], j[0]))
        left.remove(best)
        n += 1
        last[best[2] or ""] = n
        out.append(best[0])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fair_rotation(spark, seed):
    import random

    r = random.Random(seed)
    jobs = [(f"j{i:03}", r.randint(0, 2), r.choice(["a", "b", "c", None]), r.randint(0, 20)) for i in range(40)]
    served = {f: s for f, s in zip("abz", r.sample(range(1, 9), 3))} if seed % 2 else {}
    table = df(spark, list(served.items()), "facet_key string, last_served_seq long")
    got = dispatch.fair(df(spark, jobs, "id string, priority int, rate_limit_facet string, created_at long"), table)
    assert [x.id for x in got.orderBy("position").collect()] == brute_fair(jobs, served)


def test_dispatch_order(spark):
    jobs = df(spark, [("p5-old", "email", "Waiting", 5, 1, 0), ("p5-new", "email", "Waiting", 5, 2, 0), ("p1", "email", "Waiting", 1, 3, 0), ("other", "other", "Waiting", 0, 4, 0), ("later", "email", "Delayed", -1, 0, 60_000)], "id string, name string, state string, priority int, created_at long, available_at long").withColumn("rate_limit_facet", F.lit(None).cast("string"))
    order = [r.id for r in dispatch.fifo(dispatch.runnable(jobs, 1000, names=["email"])).orderBy("position").collect()]
    assert order == ["p1", "p5-old", "p5-new"] and dispatch.claim_next(dispatch.runnable(jobs, 1000)).first().id == "other"


def test_limits_block_and_status(spark):
    rules = df(spark, [("paused", 0, 1000), ("full", 2, 1000), ("over", 2, 1000), ("free", 5, 1000)], "facet_pattern string, max_jobs long, window_duration_ms long")
    counters = df(spark, [("full", 2, 501), ("over", 2, 500)], "facet_key string, current_count long, window_expires_at long")
    assert {r[0] for r in limits.blocked_facets(rules, counters, 500).collect()} == {"paused", "full"}
    assert {r.facet_pattern for r in limits.fixed_status(rules, counters, 500).where("throttled").collect()} == {"paused", "full"}
    jobs = df(spark, [("a", "full", "Waiting", 0), ("b", None, "Waiting", 0)], "id string, rate_limit_facet string, state string, available_at long")
    assert [r.id for r in dispatch.runnable(jobs, 500, rules, counters).collect()] == ["b"]
    assert dispatch.throttled(jobs, 500, rules, counters) and not dispatch.throttled(jobs, 500, rules.limit(0), counters)
    bad = df(spark, [("a", 1), ("", 1), (" a", 1), ("a*", 1), ("a", 0), (None, 1)], "f string, w long")
    assert [r[0] for r in bad.select(limits.valid_rule(F.col("f"), F.col("w"))).collect()] == [True, False, False, False, False, False]


def test_backoff_and_jitter(spark):
    b = lambda base, cap, n: spark.range(1).select(scheduling.backoff_ms(F.lit(base).cast("long"), F.lit(cap).cast("long"), F.lit(n))).first()[0]
    assert [b(100, 500, n) for n in (1, 2, 3, 4)] == [100, 200, 400, 500] and b(0, 500, 3) == 0
    assert b(2**63 - 1, 2**63 - 1, 80) == 2**63 - 1
    j = lambda d, j_, r: spark.range(1).select(scheduling.jittered_ms(F.lit(d).cast("long"), F.lit(j_), F.lit(r))).first()[0]
    assert j(1000, 0.0, 0.3) == 1000 and j(1000, 1.0, 0.0) == 0 and j(1000, 0.5, 0.0) == 500 and j(1000, 0.5, 1.0) == 1000 and j(5, 0.5, 0.0) == 3
    s = spark.range(1).select(scheduling.sat_add(F.lit(2**63 - 1), F.lit(5)), scheduling.sat_add(F.lit(-(2**63)), F.lit(-5))).first()
    assert tuple(s) == (2**63 - 1, -(2**63))


def test_cron():
    at = lambda c, z, t: cron.next_after(c, z, t)
    assert at("30 2 * * *", "America/Denver", ms("2024-03-10T00:00:00-07:00")) == ms("2024-03-10T03:00:00-06:00")
    assert at("30 1 * * *", "America/Denver", ms("2024-11-03T00:00:00-06:00")) == ms("2024-11-03T01:30:00-06:00")
    assert at("30 1 * * *", "America/Denver", ms("2024-11-03T01:30:00-06:00")) == ms("2024-11-04T01:30:00-07:00")
    assert at("0 3 * * *", None, 0) == 10_800_000 and at("*/15 * * * * *", "UTC", 0) == 15_000
    assert at("5/20 * * * *", "UTC", 0) == 300_000 and at("0 0 29 2 *", "UTC", ms("2021-01-01T00:00:00+00:00")) == ms("2024-02-29T00:00:00+00:00")
    assert at("0 0 13 * fri", "UTC", ms("2024-01-01T00:00:00+00:00")) == ms("2024-01-05T00:00:00+00:00")
    assert at("0 0 31 feb *", "UTC", 0) is None
    for bad in ("bad", "60 * * * *", "* * * *", "5-1 * * * *", "*/0 * * * *"):
        assert cron.check(bad, None).startswith("invalid cron")
    assert cron.check("* * * * *", "No/Where").startswith("invalid timezone") and cron.check("* * * * *", "") is None


def test_validation(spark):
    rows = [("k", False, 0, 0, 0, 0.0, 0, 0), ("  ", False, 0, 0, 0, 0.0, 0, 0), ("é" * 129, False, 0, 0, 0, 0.0, 0, 0), ("", True, 0, 0, 0, 0.0, 0, 0), ("", False, -1, 0, 0, 0.0, 0, 0), ("", False, 0, 50, 10, 0.0, 0, 0), ("", False, 0, 0, 0, 1.5, 0, 0), ("", False, 0, 0, 0, 0.0, 11, 0), ("", False, 0, 90_000, 0, 0.0, 0, 7)]
    r = df(spark, rows, "idempotency_key string, release_on_finish boolean, delay_ms long, retry_backoff_ms long, retry_backoff_max_ms long, retry_jitter double, execution_depth int, max_attempts int")
    got = admission.validate(r).collect()
    assert [x.invalid for x in got] == [None, "blank key", "long key", "release without key", "negative delay", "cap below base", "bad jitter", "too deep", None]
    assert (got[0].retry_backoff_max_ms, got[0].max_attempts, got[8].retry_backoff_max_ms, got[8].max_attempts) == (60_000, 3, 90_000, 7)


def test_receipts(spark):
    r = df(spark, [(1, 10, "q", "k", "a"), (2, 11, "q", "k", "a"), (3, 12, "q", "k", "b"), (4, 13, "q", "", "a"), (5, 14, "q2", "k", "b"), (6, 15, "q", "s", "x"), (7, 16, "q", "s", "y")], "seq long, t_ms long, name string, idempotency_key string, request string")
    stored = df(spark, [("q", "s", "x")], "queue_name string, idempotency_key string, request string")
    assert [x.outcome for x in admission.dedup(r, stored).orderBy("seq").collect()] == ["new", "replay", "conflict", "unkeyed", "new", "replay", "conflict"]


def test_ancestry(spark):
    known = df(spark, [("root", "t-root", 0), ("deep", "t-deep", 10)], "id string, trace_id string, execution_depth int")
    r = df(spark, [(1, None, "mine", 0), (2, "root", "spoof", 1), (3, "root", None, 0), (4, "root", None, 2), (5, "gone", None, 0), (6, "deep", None, 0), (7, "", None, 0)], "seq long, parent_id string, trace_id string, execution_depth int")
    got = {x.seq: (x.depth, x.trace, x.rejection) for x in admission.resolve_ancestry(r, known).collect()}
    assert got == {1: (0, "mine", None), 2: (1, "t-root", None), 3: (1, "t-root", None), 4: (1, "t-root", "inconsistent_depth"), 5: (0, None, "parent_not_found"), 6: (11, "t-deep", "circuit_breaker"), 7: (0, None, None)}


def test_bulk_batches(spark):
    r = df(spark, [(1, i, i != 2) for i in range(5)] + [(2, 0, True)], "batch_id int, pos int, ok boolean")
    got = {(x.batch_id, x.committed, x.batch_error) for x in admission.gate_batches(r).collect()}
    assert got == {(1, False, "bulk job 2: rejected"), (2, True, None)}
    assert {x.batch_error for x in admission.gate_batches(r, limit=4).where("batch_id = 1").collect()} == {"too many jobs"}


def test_leases_and_retries(spark):
    jobs = df(spark, [("a", "Active", "w", 1, 3, 100, 0, 60_000), ("b", "Active", "w", 3, 3, 100, 0, 60_000), ("c", "Active", "w", 1, 3, 101, 0, 60_000), ("d", "Active", "w", 2, 3, None, 100, 500)], "id string, state string, worker_id string, attempts int, max_attempts int, lease_expires_at_ms long, retry_backoff_ms long, retry_backoff_max_ms long").withColumn("available_at", F.lit(0).cast("long"))
    got = {x.id: (x.state, x.available_at, x.last_error) for x in lifecycle.recover_leases(jobs, 100).collect()}
    assert got == {"a": ("Waiting", 100, lifecycle.EXPIRED), "b": ("Failed", 0, lifecycle.EXPIRED), "d": ("Delayed", 300, lifecycle.EXPIRED)}
    calls = df(spark, [("a", "w", 1), ("c", "w", 1), ("c", "x", 1), ("c", "w", 2)], "id string, worker_id string, attempt int")
    assert [(x.id, x.lease_expires_at_ms) for x in lifecycle.heartbeat(jobs, calls, 100).collect()] == [("c", 30_100)]
    claimed = lifecycle.claim(jobs, df(spark, [("a", "me")], "id string, worker_id string"), 1000)
    a = claimed.where("id = 'a'").first()
    assert (a.worker_id, a.attempts, a.lease_expires_at_ms) == ("me", 2, 31_000) and claimed.count() == 4


def test_flow_release_and_cascade(spark):
    nodes = df(spark, [("root", None, "WaitingChildren", False, 1, 0), ("mid", "root", "WaitingChildren", True, 2, 9000), ("x", "mid", "Active", True, 0, 0), ("y", "mid", "Active", True, 0, 0), ("lone", "root", "Active", False, 0, 0)], "id string, parent_id string, state string, fail_parent_on_failure boolean, pending_children int, available_at long")
    failed = lambda *x: df(spark, [(i,) for i in x], "id string")
    got = {r.id: r.cause for r in lifecycle.fail_parents(nodes, failed("y", "x")).collect()}
    assert got == {"mid": "x", "root": "x"} and lifecycle.fail_parents(nodes, failed("lone")).count() == 0
    done = df(spark, [("x", "mid")], "id string, parent_id string")
    assert [(r.id, r.state, r.pending_children) for r in lifecycle.parent_release(nodes, done, 5).collect()] == [("mid", "WaitingChildren", 1)]
    both = df(spark, [("x", "mid"), ("y", "mid")], "id string, parent_id string")
    assert lifecycle.parent_release(nodes, both, 5).first().state == "Delayed" and lifecycle.parent_release(nodes, both, 9000).first().state == "Waiting"


def test_whole_merge_status_and_cascade(spark, sf):
    jobs = {r.id: r for r in fx.job_all(spark, sf).collect()}

    def way_up(i):
        out = [i]
        while (i := jobs[i].parent_id) is not None:
            if i not in jobs:
                return None
            out.append(i)
        return out

    ways = {i: way_up(i) for i in jobs}
    live = {i for i, r in jobs.items() if r.state not in ("Completed", "Failed") and ways[i]}
    have = Counter(ways[i][-1] for i in live)
    want = {}
    for i in jobs:
        r = jobs[i]
        want[i] = "not live" if i not in live else "active" if r.state == "Active" else "too high" if len(ways[i]) + 1 > 8 else "too many nodes" if have[ways[i][-1]] + 3 > 400 else None
    assert {r.target_id: r.error for r in q.flow_merge(spark, sf).collect()} == want

    state = {i: "Failed" if r.state == "Failed" else "Completed" if r.k % 5 == 0 else "Waiting" for i, r in jobs.items()}
    cause = {}
    for i in (i for i in jobs if state[i] == "Failed"):
        at = i
        while jobs[at].k % 3 and (up := jobs[at].parent_id) in jobs and state[up] == "Waiting":
            cause[up], at = min(cause.get(up, i), i), up
    assert cause and {r.id: r.cause for r in q.fail_parent_cascade(spark, sf).collect()} == cause

    events = fx.load(spark, sf, "events").select("event_type", "user_id", fx.epoch_ms("ts").alias("ms")).collect()
    now, w = 1_704_078_000_000, 43_200_000
    got = {r.facet_pattern: r for r in q.ingress_status(spark, sf).collect()}
    assert got.keys() == {e.event_type for e in events} | {"none"}
    for f in got.keys() - {"none"}:
        own = [e for e in events if e.event_type == f]
        start, cur, prev = min(e.ms for e in own), sum(e.user_id % 2 == 0 for e in own), sum(e.user_id % 2 == 1 for e in own)
        steps = max(0, (now - start) // w)
        start, cur, prev = (start, cur, prev) if steps == 0 else (start + w, 0, cur) if steps == 1 else (now - (now - start) % w, 0, 0)
        est = prev * max(0.0, min(1.0, (w - (now - start)) / w)) + cur
        assert (got[f].window_start, got[f].throttled) == (start, est >= 12) and abs(got[f].estimated_count - est) <= 0.5


def test_flow_validation(spark):
    trees = [{"name": "a", "children": [{"name": "b", "key": "k"}, {"name": "c", "children": [{"name": "d"}]}]}, {"name": "b", "key": "k"}, {"name": "e", "key": "taken"}]
    rows = store.flatten_flows(trees)
    nodes = df(spark, rows, "flow_no long, node_no long, parent_node_no long, name string, idempotency_key string, delay_ms long")
    receipts = df(spark, [("e", "taken")], "queue_name string, idempotency_key string")
    got = {r.flow_no: (r.nodes, r.height, r.error) for r in flows.validate_flows(nodes, receipts).collect()}
    assert got == {0: (4, 2, "duplicate key"), 1: (1, 0, "duplicate key"), 2: (1, 0, "key exists")}
    assert {r.flow_no: r.error for r in flows.validate_flows(nodes, max_height=1).collect()}[0] == "too high"
    states = {(r.flow_no, r.node_no): (r.state, r.pending_children) for r in flows.initial_states(nodes, 0).collect()}
    assert states[(0, 0)] == ("WaitingChildren", 2) and states[(0, 1)] == ("Waiting", 0) and states[(0, 2)] == ("WaitingChildren", 1)


def test_acknowledgements_and_archive(spark):
    jobs = df(spark, [("a", "Active", "w", 1, 1000, 5)], "id string, state string, worker_id string, attempts int, lease_expires_at_ms long, created_at long")
    history = df(spark, [("h", "Completed", "w", 1, 5, 7)], "id string, state string, worker_id string, attempts int, created_at long, finished_at long")
    calls = df(spark, [("a", "w", 0), ("h", "w", 0), ("h", "x", 1), ("z", "w", 1)], "id string, worker_id string, attempt int")
    assert sorted((r.id, r.worker_id, r.result) for r in lifecycle.acknowledgement(jobs, history, calls, 10).collect()) == [("a", "w", "ok"), ("h", "w", "replay"), ("h", "x", "conflict"), ("z", "w", "not_found")]
    live, past = lifecycle.archive(jobs, history, df(spark, [("a", "Completed", 99)], "id string, state string, finished_at long"))
    assert live.count() == 0 and {(r.id, r.state, r.finished_at) for r in past.collect()} == {("a", "Completed", 99), ("h", "Completed", 7)}


def test_bounded_names(spark):
    e = df(spark, [(i, i, n) for i, n in enumerate("zzabcab")], "event_id long, ts long, name string")
    got = {r.name: r.n for r in metrics.bounded_names(e, 2, ("b",)).collect()}
    assert got == {"b": 2, "z": 2, None: 3}


def test_alerts(spark):
    ev = df(spark, [(i, t * 60_000, 120.0) for i in ("fresh", "stale") for t in range(7)], "instance string, ts long, age double")
    samples = df(spark, [("fresh", t * 60_000) for t in range(7)] + [("stale", 0)], "instance string, ts long")
    aged = timeseries.alert(timeseries.fresh(ev, samples, ["instance"], 120_000), F.col("age") > 60, 300_000, ["instance"])
    assert {r.instance for r in aged.where("firing and ts = 360000").collect()} == {"fresh"}
    last = samples.groupBy("instance").agg(F.max("ts").alias("last"))
    gone = timeseries.alert(ev.join(last, "instance").withColumn("lag", F.col("ts") - F.least("last", "ts")), F.col("lag") >= 60_000, 300_000, ["instance"])
    assert {r.instance for r in gone.where("firing and ts = 360000").collect()} == {"stale"}


def test_counter_resets(spark):
    s = df(spark, [("a", 0, 10.0), ("a", 1000, 15.0), ("a", 2000, 3.0), ("a", 3000, 4.0)], "name string, ts long, value double")
    assert [r.increase for r in timeseries.increase(s, ["name"], 2000).orderBy("ts").collect()] == [0.0, 5.0, 8.0, 4.0]
    assert timeseries.rate(s, ["name"], 2000).orderBy(F.desc("ts")).first().rate == 2.0


def test_quantile_edges(spark):
    b = df(spark, [("x", 10, 0), ("x", 100, 10), ("x", None, 10), ("y", 10, 1), ("y", 100, 1), ("y", None, 4), ("z", 10, 0), ("z", 100, 0), ("z", None, 0)], "m string, le long, n long")
    got = {r.m: r.quantile for r in timeseries.histogram_quantile(b, 0.5, ["m"]).collect()}
    assert got == {"x": 55.0, "y": 100.0, "z": None}


def test_load_report(spark):
    v = df(spark, [("a", float(i)) for i in range(1, 101)], "g string, v double")
    p = loadreport.percentiles(v, "v", ["g"]).first()
    assert (p.p50, p.p95, p.p99, p.max) == (50.0, 95.0, 99.0, 100.0)
    one = df(spark, [("a", 1.0, 5.0)], "g string, x double, y double")
    assert loadreport.slope(one, "x", "y", ["g"]).first().slope == 0.0


def test_schedulers(spark):
    old = df(spark, [("s", "j", "* * * * *", 5, 100, "job-1", 1, 2)], "id string, job_name string, cron string, produced_count long, next_run_at long, last_job_id string, created_at long, updated_at long")
    new = df(spark, [("s", "j2", "0 * * * *", 0, 900, None, 50, 50), ("t", "k", "0 * * * *", 0, 900, None, 50, 50)], old.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", "))
    got = {r.id: r for r in schedulers.define(old, new).collect()}
    assert (got["s"].job_name, got["s"].produced_count, got["s"].last_job_id, got["s"].created_at, got["s"].next_run_at) == ("j2", 5, "job-1", 1, 900) and got["t"].created_at == 50
    many = df(spark, [("a", "j", "bad", None, 0, 10), ("b", "j", "* * * * *", None, 0, 10), ("c", "j", "* * * * *", None, 0, 10**13)], "id string, job_name string, cron string, timezone string, produced_count long, next_run_at long").withColumns({"payload": F.lit(b""), "priority": F.lit(None).cast("int"), "last_job_id": F.lit(None).cast("string"), "updated_at": F.lit(0).cast("long")})
    jobs, after = schedulers.fire(many, 60_000)
    assert [r.scheduler_id for r in jobs.collect()] == ["b"]
    assert {r.id: r.next_run_at for r in after.collect()} == {"a": 10, "b": 120_000, "c": 10**13}


def test_outbox(spark):
    r = df(spark, [("k", 2, "pending"), ("k", 1, "pending"), ("m", 3, "pending"), ("s", 0, "sent")], "key string, created_at long, state string")
    batch = outbox.next_batch(outbox.first_writer_wins(r, ["created_at"]), ["created_at"])
    assert [(x.key, x.created_at) for x in batch.collect()] == [("k", 1), ("m", 3)]
    got = outbox.settle(batch, df(spark, [("k", "ok"), ("m", "unavailable")], "key string, answer string"))
    assert {x.key: x.state for x in got.collect()} == {"k": "sent", "m": "pending"}


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    jobs = store.empty(spark, "jobs")
    for t in (1, 2, 3, 4):
        store.write_snapshot(spark, root, {"jobs": jobs, "extra": spark.range(t)}, t, keep=2)
    assert [p[-1] for p in store.list_snapshots(spark, root)] == ["3", "4"]
    back = store.read_snapshot(spark, root)
    assert back["jobs"].schema.names == jobs.schema.names and back["extra"].count() == 4
    assert store.read_snapshot(spark, f"{root}-none") == {}


def test_older_tables_conform(spark):
    old = df(spark, [("a", "Active", 5), ("d", "Delayed", 6), ("w", "Waiting", 7)], "id string, state string, created_at long")
    got = {r.id: r for r in schemas.conform(old, "jobs").collect()}
    assert got["a"].lease_expires_at_ms == 0 and got["d"].available_at is None and got["w"].available_at == 7 and got["w"].max_attempts == 3


def test_workload(spark):
    a, b = (workload.requests(spark, 5000, seed=3) for _ in range(2))
    assert a.exceptAll(b).count() == 0
    n = {r.name: r["count"] for r in a.groupBy("name").count().collect()}
    assert set(n) == {x for x, _ in workload.MIX} and 0.4 < n["IngestEvent"] / 5000 < 0.6
    kids = workload.next_in_chain(df(spark, [("1", "ProcessTask"), ("2", "WriteRecord")], "id string, name string"))
    assert [(r.parent_id, r.name, r["index"]) for r in kids.orderBy("index").collect()] == [("1", "ProcessSubtask", 0), ("1", "ProcessSubtask", 1)]
