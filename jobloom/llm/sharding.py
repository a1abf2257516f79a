"""Global shuffle into shards by a two-pass external shuffle.

Pass one scatters every record, by a seeded hash of its id and text, into a bucket
small enough for memory; a shard is made of whole buckets. Equal records that would
not fit into one bucket are scattered by their place in the input besides, so that a
hot record fills no bucket. Pass two reads one bucket at a time,
puts it in a fixed order, shuffles it with Fisher-Yates under a seed of its own
and writes it. A lost task writes the same bucket again in the same order.

The shard follows the law ``key``: of all shards, the one with the highest hash of
(id, shard) takes the record. The id and the number of shards alone decide, and
one more shard takes records only into itself.

Defined results: a null text has no bytes and the CRC of the empty text; a null
id is an id like any other for the law, and its records spread over the buckets of
their shard by text; repeated rows each get a slot; whole texts are moved; columns of the
input named like those made here are replaced; an empty table writes no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 32 << 20
SEED = 4
#: Rows of the table of bucket offsets up to which it is broadcast (24 bytes each).
BROADCAST_BUCKETS = 100_000
#: Tasks of pass two at most; each takes its buckets one after another.
TASKS = 20_000
_OWN = ("shard", "grown_shard", "bucket", "place", "size", "text_crc32")


def key_shard(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash; adding a shard moves records only there."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.xxhash64(key, j, F.lit(seed)))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write all records, shuffled, as Parquet: columns of ``docs`` (those with a
    name of this operator's own excepted) with shard, bucket and place."""
    keep = [c for c in docs.columns if c not in _OWN]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16
    total = docs.agg(F.sum(size)).first()[0] or 0
    each = max(1, -(-total // (shards * bucket_bytes)))  # buckets of a shard
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(*keep, size.alias("size"), crc.alias("text_crc32"), key_shard(F.col(id_col), shards, seed).alias("shard"), key_shard(F.col(id_col), shards + 1, seed).alias("grown_shard"))
    hot = docs.select(F.col(id_col).alias("_i"), crc.alias("_c"), size.alias("_s")).groupBy("_i", "_c").agg(F.sum("_s").alias("_s"), F.count("*").alias("_n")).where((F.col("_s") > bucket_bytes) & (F.col("_n") > 1)).select("_i", "_c")
    salt = F.lit(0).cast("long")
    if each > 1 and (n_hot := hot.count()):
        # records of which a bucket can't hold all: equal ones, so that it makes no difference which of them goes where
        hot = F.broadcast(hot) if n_hot <= BROADCAST_BUCKETS else hot
        rows = rows.join(hot.withColumn("_hot", F.lit(True)), F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("text_crc32") == F.col("_c")), "left")
        salt = F.when(F.col("_hot"), F.monotonically_increasing_id() + 1).otherwise(0)
    rows = rows.withColumn("_salt", salt).withColumn("bucket", F.col("shard").cast("long") * each + F.pmod(F.xxhash64(id_col, "text_crc32", "_salt", F.lit(seed + 1)), F.lit(each)))
    rows = rows.drop("_salt", "_hot", "_i", "_c").repartition(min(TASKS, shards * each), "bucket")
    rows = rows.withColumn("place", F.lit(0).cast("long"))
    order = [(id_col, "ascending"), ("text_crc32", "ascending"), *((c, "ascending") for c, t in docs.dtypes if c in keep and c not in (id_col, text_col) and t in ("string", "int", "bigint", "double"))]

    def fisher_yates(bucket: pa.Table) -> pa.Table:
        start = pc.sort_indices(bucket, sort_keys=order)
        rng = np.random.default_rng([seed, bucket.column("bucket")[0].as_py()])
        deal = np.arange(bucket.num_rows)
        rng.shuffle(deal)
        out = bucket.take(start.take(pa.array(deal)))
        return out.set_column(out.schema.get_field_index("place"), "place", pa.array(np.arange(out.num_rows)))

    rows.groupBy("bucket").applyInArrow(fisher_yates, rows.schema).write.parquet(path)


def read_shards(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The written records with ``slot``: the place within the shard, gapless from 0."""
    rows = spark.read.parquet(path)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if counts.count() <= BROADCAST_BUCKETS:
        base = F.broadcast(base)
    return rows.join(base, "bucket").withColumn("slot", F.col("base") + F.col("place")).drop("base")
