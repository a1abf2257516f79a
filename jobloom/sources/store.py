"""Snapshots of a set of tables: atomic writes, pruning, restore, and simple sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.schemas import DDL, conform, schema

KEEP = 3


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_snapshot(spark: SparkSession, root: str, tables: dict[str, DataFrame], now_ms: int, keep: int = KEEP) -> str:
    """Write all tables, show them under their name in one rename, and drop the oldest beyond ``keep``.

    Rows of the large tables are sorted within files by end time, so that row groups
    can be skipped.
    """
    fs, path = _fs(spark, root)
    name, tmp = f"{root}/snapshot-{now_ms:013d}", f"{root}/.tmp-{now_ms:013d}"
    fs.delete(path(tmp), True)
    for table, df in tables.items():
        order = [c for c in ("finished_at", "created_at", "id") if c in df.columns]
        (df.sortWithinPartitions(*order) if order else df).write.parquet(f"{tmp}/{table}")
    if not fs.rename(path(tmp), path(name)):
        raise OSError(f"{name} can't be put in place")
    for old in list_snapshots(spark, root)[:-keep] if keep > 0 else []:
        fs.delete(path(old), True)
    return name


def list_snapshots(spark: SparkSession, root: str) -> list[str]:
    """Whole snapshots, oldest first; unfinished ones don't count."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    return [f"{root}/{n}" for n in sorted(names) if n.startswith("snapshot-")]


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest snapshot, brought to the present schema."""
    found = list_snapshots(spark, root)
    if not found:
        return {}
    fs, path = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path(found[-1]))]
    return {n: conform(spark.read.parquet(f"{found[-1]}/{n}"), n) if n in DDL else spark.read.parquet(f"{found[-1]}/{n}") for n in names}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def json_feed(df: DataFrame) -> DataFrame:
    """One JSON document for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of enqueue requests, with an explicit schema."""
    return spark.read.schema("seq long, t_ms long, name string, facet string, idempotency_key string, trace_id string, parent_id string, execution_depth int, request string, delay_ms long").json(path)


def flatten_flows(trees: list[dict]) -> list[tuple]:
    """Nested flows ({name, key?, delay_ms?, children?}) as rows (flow_no, node_no, parent_node_no, name, key, delay), parents first."""
    rows = []
    for flow, tree in enumerate(trees):
        todo, n = [(tree, None)], 0
        while todo:
            node, parent = todo.pop(0)
            rows.append((flow, n, parent, node["name"], node.get("key"), node.get("delay_ms", 0)))
            todo += [(c, n) for c in node.get("children", ())]
            n += 1
    return rows
