"""Admission as one transition, against a plain writer and by example."""

from pyspark.sql import functions as F

from jobloom.operators import admission
from jobloom.plans import queries as q

REQUEST = "seq long, t_ms long, name string, idempotency_key string, request string, facet string, parent_id string, trace_id string, execution_depth int, id string, delay_ms long"
KNOWN = "id string, trace_id string, execution_depth int"


def decide(spark, rows, known=(), **how):
    full = [dict(zip(["seq", "t_ms", "name", "idempotency_key", "request", "facet", "parent_id", "trace_id", "execution_depth", "id", "delay_ms"], [i, i, "n", None, f"r{i}", None, None, None, 0, f"j{i}", 0])) | r for i, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(r.values()) for r in full], REQUEST)
    how = {"limit": None, "window_ms": 1000, "new_trace": F.concat(F.lit("new-"), F.col("seq").cast("string"))} | how
    return admission.admit(df, spark.createDataFrame(list(known), KNOWN), **how).orderBy("seq").collect()


def status(rows):
    return [r.status for r in rows]


def test_roots_without_a_trace_have_lineages_of_their_own(spark):
    got = decide(spark, [{}, {}, {"trace_id": ""}, {"trace_id": "t"}, {"trace_id": "t"}], chain_cap=1)
    assert status(got) == ["accepted"] * 4 + ["chain_quarantine"]
    assert [r.trace for r in got] == ["new-0", "new-1", "new-2", "t", "t"]
    assert got[4].detail == "chain quarantined: lineage t exceeded max chain size 1"
    assert len({r.trace for r in decide(spark, [{}, {}], new_trace=None)}) == 2


def test_a_refused_request_leaves_no_receipt(spark):
    again = {"idempotency_key": "k", "parent_id": "p", "request": "same"}
    assert status(decide(spark, [again, again])) == ["parent_not_found", "parent_not_found"]
    later = [again, {"id": "p"}, again, again, again | {"request": "other"}]
    got = decide(spark, later)
    assert status(got) == ["parent_not_found", "accepted", "accepted", "replay", "conflict"]
    assert [r.first_seq for r in got] == [None, None, 2, 2, 2] and got[2].depth == 1


def test_velocity_comes_before_ancestry(spark):
    f = {"facet": "f"}
    got = decide(spark, [f, f | {"parent_id": "none"}, {"parent_id": "none"}], limit=1)
    assert status(got) == ["accepted", "ingress_velocity", "parent_not_found"]
    assert got[1].detail == "ingress velocity limit exceeded for facet f"


def test_a_refusal_gives_its_quota_back(spark):
    rows = [{"facet": "f", "trace_id": "a"}, {"facet": "f", "trace_id": "a"}, {"facet": "f", "trace_id": "b"}, {"facet": "f", "trace_id": "c"}]
    assert status(decide(spark, rows, limit=2, chain_cap=1)) == ["accepted", "chain_quarantine", "accepted", "ingress_velocity"]


def test_parents_of_the_same_batch_and_of_the_tables(spark):
    rows = [{"trace_id": "t"}, {"parent_id": "j0", "trace_id": "spoofed"}, {"parent_id": "j1", "execution_depth": 7}, {"parent_id": "j2"}, {"parent_id": "old", "execution_depth": 10}, {"parent_id": "j4"}]
    got = decide(spark, rows, [("old", "o", 9)])
    assert status(got) == ["accepted", "accepted", "inconsistent_depth", "parent_not_found", "accepted", "circuit_breaker"]
    assert [(r.depth, r.trace) for r in got[:2]] == [(0, "t"), (1, "t")] and (got[4].depth, got[4].trace) == (10, "o")
    assert got[2].detail == "ancestry: execution_depth 7 must equal parent depth + 1 (2)"
    assert got[5].detail == "Circuit breaker tripped: execution depth 11 exceeds max allowed 10"


def test_stored_state_and_initial_states(spark):
    receipts = spark.createDataFrame([("n", "k", "r0")], "queue_name string, idempotency_key string, request string")
    counters = spark.createDataFrame([("full", 3)], "trace_id string, job_count long")
    windows = spark.createDataFrame([("f", 0, 2, 0)], "facet_key string, current_window_start long, current_count long, previous_count long")
    rows = [{"idempotency_key": "k"}, {"idempotency_key": "k"}, {"trace_id": "full"}, {"facet": "f", "delay_ms": 5}, {"facet": "f"}, {"delay_ms": 2**63 - 1}]
    got = decide(spark, rows, receipts=receipts, counters=counters, windows=windows, chain_cap=3, limit=3)
    assert status(got) == ["replay", "conflict", "chain_quarantine", "accepted", "ingress_velocity", "invalid"]
    assert (got[3].state, got[3].available_at, got[3].window_count) == ("Delayed", 8, 3) and got[4].state is None


def test_groups_have_writers_of_their_own(spark):
    rows = [{"name": n, "facet": n, "trace_id": n} for n in "abab" * 10]
    one, own = decide(spark, rows, limit=3, chain_cap=5), decide(spark, rows, limit=3, chain_cap=5, groups=["name"])
    assert status(one) == status(own) and status(own).count("accepted") == 6


def plain_writer(rows, known, limit, window, cap, max_depth):
    """The gates one after another over plain rows; state changes only on acceptance."""
    receipts, buckets, chains, jobs = {}, {}, {}, dict(known)
    for r in sorted(rows, key=lambda r: (r.t_ms, r.seq)):
        key = (r.name, r.idempotency_key)
        if r.idempotency_key and key in receipts:
            yield r.seq, "replay" if receipts[key] == r.request else "conflict"
            continue
        start, now, before = buckets.get(r.facet, (r.t_ms, 0, 0))
        steps = max(0, (r.t_ms - start) // window)
        if steps == 1:
            start, now, before = start + window, 0, now
        elif steps > 1:
            start, now, before = r.t_ms - (r.t_ms - start) % window, 0, 0
        if before * min(1, max(0, (window - (r.t_ms - start)) / window)) + now >= limit:
            yield r.seq, "ingress_velocity"
            continue
        trace, depth = r.trace_id or f"new-{r.seq}", r.execution_depth
        if r.parent_id:
            if r.parent_id not in jobs:
                yield r.seq, "parent_not_found"
                continue
            trace, above = jobs[r.parent_id]
            if depth not in (0, above + 1):
                yield r.seq, "inconsistent_depth"
                continue
            depth = above + 1
        if depth > max_depth:
            yield r.seq, "circuit_breaker"
            continue
        if chains.get(trace, 0) >= cap:
            yield r.seq, "chain_quarantine"
            continue
        chains[trace] = chains.get(trace, 0) + 1
        buckets[r.facet] = start, now + 1, before
        receipts[key] = r.request
        jobs[r.id] = trace, depth
        yield r.seq, "accepted"


def test_admission_query_matches_a_plain_writer(spark):
    sf = "/root/testdata/sf0.01"
    got = q.admission_pipeline(spark, sf).collect()
    known = {r.id: (r.trace_id, r.execution_depth) for r in q._known(spark, sf).collect()}
    want = dict(plain_writer(q._asked(spark, sf).collect(), known, q.ADMIT_LIMIT, q.INGRESS_WINDOW, 3, 8))
    assert {r.seq: r.status for r in got} == want
    assert set(want.values()) >= {"accepted", "replay", "conflict", "ingress_velocity", "parent_not_found", "inconsistent_depth", "chain_quarantine"}
    kinds = {r.kind: r.n for r in q.rejections_by_kind(spark, sf).collect()}
    assert kinds == {k: sum(v == k for v in want.values()) for k in kinds} and sum(kinds.values()) == sum(v not in ("accepted", "replay", "conflict") for v in want.values())
    feed = q.rejections_feed(spark, sf).collect()
    assert len(feed) == 200 and all(r.detail for r in feed)
