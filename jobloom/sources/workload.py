"""A deterministic synthetic workload: weighted kinds of jobs, and a chain that fans out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of root jobs and their weights in percent, tenants, and the chain of children.
MIX = (("IngestEvent", 50), ("ProcessTask", 35), ("Delay", 8), ("Stress", 4), ("Throw", 3), ("RecursiveProbe", 1))
TENANTS = 4
CHAIN = ("IngestEvent", "ProcessTask", "ProcessSubtask", "WriteRecord")


def requests(spark: SparkSession, n: int, seed: int = 0, every_ms: int = 5) -> DataFrame:
    """``n`` root requests; each depends on its number and the seed only."""
    draw = F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(sum(w for _, w in MIX)))
    kind, low = F.lit(None).cast("string"), 0
    for name, weight in MIX:
        kind, low = F.when((draw >= low) & (draw < low + weight), name).otherwise(kind), low + weight
    tenant = F.concat(F.lit("tenant-"), F.pmod(F.xxhash64("seq", F.lit(seed + 1)), F.lit(TENANTS)).cast("string"))
    return spark.range(n).select(F.col("id").alias("seq"), (F.col("id") * every_ms).alias("t_ms")).withColumns({"name": kind, "facet": tenant})


def next_in_chain(jobs: DataFrame, fan_out: int = 2) -> DataFrame:
    """The children that finished jobs of the chain enqueue."""
    following = F.coalesce(*(F.when(F.col("name") == a, b) for a, b in zip(CHAIN, CHAIN[1:])))
    out = jobs.withColumn("_next", following).where("_next is not null")
    count = F.when(F.col("name") == "ProcessTask", fan_out).otherwise(1)
    return out.select(F.col("id").alias("parent_id"), F.col("_next").alias("name"), F.explode(F.sequence(F.lit(0), count - 1)).alias("index"))
