"""Transitions that take several tables, the shipped alert rules, claims against a plain fold."""

from pyspark.sql import functions as F

from jobloom.operators import dispatch, flows, handlers, lifecycle, timeseries
from jobloom.schemas import DDL, conform
from jobloom.streaming import periodic


def jobs_of(spark, rows):
    """Jobs from dicts; what they lack has its default."""
    cols = sorted({c for r in rows for c in r})
    kinds = dict(x.strip().split(" ") for x in DDL["jobs"].split(","))
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], ", ".join(f"{c} {kinds[c]}" for c in cols))
    return conform(df, "jobs")


def rows_of(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


NODES = "flow_no long, node_no long, parent_node_no long, id string, name string, idempotency_key string, delay_ms long, rate_limit_facet string"
EMPTY_RECEIPTS = DDL["enqueue_receipts"]


def test_insert_flows(spark):
    nodes = spark.createDataFrame([
        (1, 0, None, "a", "x", "k1", 0, ""), (1, 1, 0, "b", "x", None, 0, "t"), (1, 2, 0, "c", "x", "", 5, None), (1, 3, 2, "d", "x", None, 0, None),
        (2, 0, None, "e", "x", "used", 0, None), (2, 1, 0, "f", "x", None, 0, None),
    ], NODES)
    receipts = spark.createDataFrame([("x", "used", None, "z", "Waiting", 1, False)], EMPTY_RECEIPTS)
    made, kept, verdicts = flows.insert(nodes, receipts, 100)
    assert rows_of(made, "id", "parent_id", "state", "pending_children", "tree_id", "trace_id", "tree_depth", "execution_depth", "available_at", "rate_limit_facet") == {
        ("a", None, "WaitingChildren", 2, "a", "a", 0, 0, 100, None), ("b", "a", "Waiting", 0, "a", "a", 1, 1, 100, "t"),
        ("c", "a", "WaitingChildren", 1, "a", "a", 1, 1, 105, None), ("d", "c", "Waiting", 0, "a", "a", 2, 2, 100, None),
    }
    assert rows_of(kept, "queue_name", "idempotency_key", "job_id", "initial_state", "release_on_finish") == {("x", "k1", "a", "WaitingChildren", False)}
    assert rows_of(verdicts, "flow_no", "error") == {(1, None), (2, "key exists")}
    assert flows.insert(nodes, receipts, 100, whole=True)[0].count() == 0


def test_merge_flows(spark):
    jobs = jobs_of(spark, [
        {"id": "t", "name": "x", "state": "Waiting", "created_at": 1, "available_at": 1}, {"id": "u", "name": "x", "state": "Active", "created_at": 1, "lease_expires_at_ms": 9},
        {"id": "w", "name": "x", "state": "WaitingChildren", "created_at": 1, "pending_children": 1, "tree_id": "r", "tree_depth": 2}, {"id": "deep", "name": "x", "state": "Delayed", "created_at": 1, "tree_id": "r", "tree_depth": 9},
    ])
    receipts = spark.createDataFrame([("x", k, None, k, "Waiting", 1, False) for k in ("t", "u", "w", "deep", "ended")], EMPTY_RECEIPTS)
    added = spark.createDataFrame(
        [("x", t, n, p, f"{t}{n}", "y", k, 0) for t in ("t", "u", "w", "deep", "ended", "none") for n, p, k in ((0, None, f"new-{t}"), (1, 0, None), (2, None, None))],
        "target_name string, target_key string, node_no long, parent_node_no long, id string, name string, idempotency_key string, delay_ms long",
    )
    after, kept, verdicts = flows.merge(jobs, receipts, added, 50)
    assert rows_of(verdicts, "target_key", "error") == {("t", None), ("u", "active"), ("w", None), ("deep", "too high"), ("ended", "not live"), ("none", "not found")}
    assert rows_of(after, "id", "state", "pending_children", "parent_id", "tree_id", "tree_depth") == {
        ("t", "WaitingChildren", 2, None, "t", 0), ("t0", "WaitingChildren", 1, "t", "t", 1), ("t1", "Waiting", 0, "t0", "t", 2), ("t2", "Waiting", 0, "t", "t", 1),
        ("w", "WaitingChildren", 3, None, "r", 2), ("w0", "WaitingChildren", 1, "w", "r", 3), ("w1", "Waiting", 0, "w0", "r", 4), ("w2", "Waiting", 0, "w", "r", 3),
        ("u", "Active", 0, None, None, 0), ("deep", "Delayed", 0, None, "r", 9),
    }
    assert rows_of(kept, "idempotency_key", "job_id") - rows_of(receipts, "idempotency_key", "job_id") == {("new-t", "t0"), ("new-w", "w0")}


def test_finish_with_handlers(spark):
    claimed = {"state": "Active", "name": "good", "worker_id": "w", "attempts": 1, "created_at": 1, "lease_expires_at_ms": 99, "priority": 1, "payload": b"p"}
    jobs = jobs_of(spark, [
        {**claimed, "id": "done", "parent_id": "p1"}, {**claimed, "id": "again", "name": "bad", "retry_backoff_ms": 7}, {**claimed, "id": "lost", "name": "worse", "parent_id": "p2", "fail_parent_on_failure": True},
        {**claimed, "id": "plain", "name": "none", "parent_id": "p1"}, {**claimed, "id": "late", "lease_expires_at_ms": 10},
        {"id": "p1", "name": "p", "state": "WaitingChildren", "created_at": 1, "pending_children": 1}, {"id": "p2", "name": "p", "state": "WaitingChildren", "created_at": 1, "pending_children": 2, "parent_id": "p3", "fail_parent_on_failure": True},
        {"id": "p3", "name": "p", "state": "WaitingChildren", "created_at": 1, "pending_children": 1, "parent_id": "p4"}, {"id": "p4", "name": "p", "state": "WaitingChildren", "created_at": 1, "pending_children": 1},
    ])

    def bad(payload):
        raise ValueError("later")

    def worse(payload):
        raise handlers.NoRetry("never")

    calls = handlers.handle(jobs.where("state = 'Active'"), {"good": lambda p: p + b"!", "bad": bad, "worse": worse})
    history = spark.createDataFrame([], DDL["job_history"])
    receipts = spark.createDataFrame([("q", k, None, k, "Waiting", 1, r) for k, r in (("done", True), ("lost", False), ("again", True), ("p2", True))], EMPTY_RECEIPTS)
    live, past, left = lifecycle.finish(jobs, history, receipts, calls, 50)
    assert rows_of(live, "id", "state", "available_at", "worker_id", "last_error", "pending_children") == {
        ("again", "Delayed", 57, None, "later", 0), ("late", "Active", 1, "w", None, 0), ("p1", "Waiting", 1, None, None, 0), ("p4", "WaitingChildren", 1, None, None, 1),
    }
    child = "failParentOnFailure: child lost failed"
    assert rows_of(past, "id", "state", "finished_at", "last_error", F.col("result").cast("string")) == {
        ("done", "Completed", 50, None, "p!"), ("lost", "Failed", 50, "never", None), ("plain", "Failed", 50, "no handler for none", None), ("p2", "Failed", 50, child, None), ("p3", "Failed", 50, child, None),
    }
    assert rows_of(left, "job_id") == {("lost",), ("again",)}


def test_claims_against_a_plain_fold(spark):
    facets = ["", "a", "b", "c", "d"]
    rows = [(f"{i:03}", i % 3, (i * 37) % 11, facets[(i * 7 + i // 9) % 5] or None) for i in range(90)]
    jobs = spark.createDataFrame([(i, "q", "Waiting", p, c, f, 0) for i, p, c, f in rows], "id string, name string, state string, priority int, created_at long, rate_limit_facet string, available_at long")
    rules, counters = [("a", 0, 10), ("b", 5, 10), ("c", 4, 10)], [("b", 2, 101), ("c", 4, 100)]
    served = [("d", 3, 1), ("c", 1, 1)]
    table = [(rules, "facet_pattern string, max_jobs long, window_duration_ms long"), (counters, "facet_key string, current_count long, window_expires_at long"), (served, "facet_key string, last_served_seq long, last_served_at long")]
    r, c, s = (spark.createDataFrame(*t) for t in table)
    for rotate in (False, True):
        used, turn, left, want = {f: (n, u) for f, n, u in counters}, {f: n for f, n, _ in served}, list(rows), []
        limit = {f: (m, w) for f, m, w in rules}
        for _ in range(25):
            count = lambda f: used[f][0] if f in used and used[f][1] > 100 else 0
            can = [x for x in left if x[3] not in limit or count(x[3]) < limit[x[3]][0]]
            can = [x for x in can if x[1] == min(y[1] for y in can)]
            if rotate:
                head = {f: min((y[2], y[0]) for y in can if y[3] == f) for f in {y[3] for y in can}}
                facet = min(head, key=lambda f: (turn.get(f or "", -1), head[f]))
                can = [x for x in can if x[3] == facet]
            got = min(can, key=lambda x: (x[2], x[0]))
            want.append(got[0])
            left.remove(got)
            if got[3] in limit:
                used[got[3]] = (count(got[3]) + 1, used[got[3]][1] if got[3] in used and used[got[3]][1] > 100 else 100 + limit[got[3]][1])
            turn[got[3] or ""] = max(turn.values(), default=0) + 1
        taken, after, turns = dispatch.claim_batch(jobs, 100, 25, r, c, s, rotate)
        assert [x.id for x in taken.orderBy("position").collect()] == want
        assert rows_of(after, "facet_key", "current_count", "window_expires_at") == {(f, n, u) for f, (n, u) in used.items()}
        assert rows_of(turns, "facet_key", "last_served_seq") == set(turn.items())


def test_shipped_alerts(spark):
    """A fresh sample of aging work fires after five minutes; a stale one only says that it is stale."""
    rows = [(w, m * 60_000, m * 60_000 if w == "fresh" else 0, 120, 0, 0, 0) for w in ("fresh", "stale") for m in range(11)]
    e = spark.createDataFrame(rows, "instance string, ts long, sample_ts long, oldest_due_age_s long, due long, expired_leases long, recovery_errors long")
    fired = timeseries.pressure_alerts(e, ["instance"])
    assert rows_of(fired.where("ts = 360000"), "instance", "alert") == {("fresh", "due_aging"), ("stale", "sample_stale")}
    assert rows_of(fired.where("ts = 240000 and instance = 'fresh'"), "alert") == set()


def test_periodic_steps(spark, tmp_path):
    last, ran = {}, []
    for now in range(0, 10_001, 500):
        for s in periodic.due_steps(last, now):
            last[s] = now
            ran.append((s, now))
    assert [t for s, t in ran if s == "recovery"] == [0, 5_000, 10_000]
    assert len([t for s, t in ran if s == "scheduler"]) == 11 and [t for s, t in ran if s == "retention"] == [0]
    seen = []
    spark.createDataFrame([(1_000,), (4_000,)], "now_ms long").write.parquet(f"file://{tmp_path}/ticks")
    ticks = spark.readStream.schema("now_ms long").parquet(f"file://{tmp_path}/ticks")
    assert periodic.run(ticks, {"sampler": seen.append}, f"file://{tmp_path}/cp")["sampler"] == 4_000 and seen[-1] == 4_000
