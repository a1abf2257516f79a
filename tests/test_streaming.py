"""Streams of several micro-batches give what one batch gives."""

from pyspark.sql import functions as F

from jobloom.operators import admission
from jobloom.plans import queries as q
from jobloom.sources import fixtures as fx
from jobloom.streaming import loop, state, wiring

REQUEST = "seq long, t_ms long, name string, facet string, idempotency_key string, request string, trace_id string, parent_id string, execution_depth int"


def parts(spark, sf, path, n=2):
    """The requests in files that follow each other in time."""
    import time

    r = fx.requests(spark, sf).select("seq", "t_ms", "name", "facet", "idempotency_key", "request", "trace_id").withColumns({"parent_id": F.when(F.col("seq") % 9 == 0, "none").otherwise(F.lit(None).cast("string")), "execution_depth": F.lit(0)})
    cuts = r.approxQuantile("t_ms", [i / n for i in range(1, n)], 0.0)
    bounds = [-1, *cuts, 2**60]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        r.where((F.col("t_ms") > lo) & (F.col("t_ms") <= hi)).coalesce(1).write.parquet(f"{path}/in/p{i}")
        time.sleep(1.1)  # files are taken by age
    return r, spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def test_state_lives_from_batch_to_batch(spark, sf, tmp_path):
    r, stream = parts(spark, sf, f"file://{tmp_path}")
    got = wiring.drain(state.sliding_admission(stream.select("seq", "t_ms", "facet"), q.INGRESS_LIMIT, q.INGRESS_WINDOW), f"file://{tmp_path}/a")
    want = q.ingress_admission(spark, sf)
    assert {tuple(x) for x in got.select("seq", "admitted").collect()} == {tuple(x) for x in want.select("seq", "admitted").collect()}
    got = wiring.drain(state.dedup_receipts(stream.select("seq", "t_ms", "name", "idempotency_key", "request")), f"file://{tmp_path}/b")
    want = q.dedup_receipts(spark, sf)
    assert {tuple(x) for x in got.select("seq", "outcome", "first_seq").collect()} == {tuple(x) for x in want.select("seq", "outcome", "first_seq").collect()}


def test_loop_decides_as_one_batch_does(spark, sf, tmp_path):
    r, stream = parts(spark, sf, f"file://{tmp_path}")
    root = f"file://{tmp_path}/loop"
    loop.run(stream, root, chain_cap=4, limit=1, window_ms=q.INGRESS_WINDOW)
    got = {(x.seq, x.status, x.depth) for x in loop.decisions(spark, root).collect()}
    known = spark.createDataFrame([], "id string, trace_id string, execution_depth int")
    whole = admission.admit(r.withColumn("id", F.col("seq").cast("string")), known, 1, q.INGRESS_WINDOW, 4)
    assert got == {(x.seq, x.status, x.depth) for x in whole.collect()}
    assert {s for _, s, _ in got} >= {"accepted", "conflict", "parent_not_found", "ingress_velocity"}
    jobs = spark.read.parquet(f"{root}/jobs")
    assert jobs.where("state IS NULL OR available_at IS NULL").isEmpty() and jobs.count() == sum(s == "accepted" for _, s, _ in got)
    # a batch that runs again under its number replaces what it has written
    first = [x.seq for x in spark.read.parquet(f"{root}/decisions").where("epoch = 0").collect()]
    loop.admit_batch(r.where(F.col("seq").isin(first)), 0, root, chain_cap=4, limit=1, window_ms=q.INGRESS_WINDOW)
    assert first and got == {(x.seq, x.status, x.depth) for x in loop.decisions(spark, root).collect()}
