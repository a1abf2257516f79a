"""From raw documents to packed sequences, stage by stage.

Every stage works on all that the stage before it has kept; what it returns is
written as Parquet to the shared folder and read again as the next one's documents.

Stages read ``doc_id``, ``text`` and ``lang`` by name; all columns go through each stage
under names of no meaning, so extra columns may have any name and are kept as they are.
Rows are told apart by id and text: equal rows are copies of one another, rows of one id
with different texts are judged each for itself, and rows without an id are documents
like others. Documents without letters, null and empty texts among them, leave in the
first stage; whole texts are read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import decontaminate, jaccard_join, packing, secrets
from jobloom.llm import language_id as li
from jobloom.llm.common import load, stage
from jobloom.llm.queries import tokenizer_path

#: Near duplicates: five-word shingles, a similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 80, 100


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with plain column names, these by the old ones, and the way back."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, lambda df: df.select(*(F.col(n).alias(c) for c, n in names.items()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text or no letters) go."""
    docs, name, back = _aside(docs)
    model = li.fit(li.bounded_sample(docs, name["text"], name["lang"]))
    return back(li.identify(docs, model, name["text"]).where(F.col("lang_pred") != "und"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (without ids: the smallest hash of a text)."""
    docs, name, back = _aside(docs)
    i, text = F.col(name["doc_id"]), F.col(name["text"])
    docs = docs.withColumn("_key", F.struct(i.isNull().alias("none"), i.alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("g")))
    found = jaccard_join.join(docs.select("_key", text), NUM, DEN, SHINGLE, "_key", name["text"])
    kept = stage(found.where(F.col("_key") == F.col("component_id")).groupBy("_key").agg(F.count("*").alias("rows")), "kept")
    one = docs.join(kept.where("rows = 1"), "_key", "left_semi")
    many = docs.join(kept.where("rows > 1"), "_key", "left_semi").dropDuplicates(["_key"])
    return back(one.unionByName(many))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs, name, back = _aside(docs)
    return back(decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"), name["text"]).where("n_hit = 0"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and ``n_chars`` follows; all documents stay."""
    kinds = dict(docs.dtypes)
    docs, name, back = _aside(docs)
    found = secrets.scan(docs, name["text"])
    masked = F.size("spans") > 0
    found = found.withColumn(name["text"], secrets.mask(F.col(name["text"]), F.col("spans")))
    if "n_chars" in kinds:
        n = F.col(name["n_chars"])
        found = found.withColumn(name["n_chars"], F.when(masked, F.char_length(name["text"]).cast(kinds["n_chars"])).otherwise(n))
    return back(found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    docs, name, _ = _aside(docs)
    out = packing.pack(docs, tokenizer_path(), name["text"], keep=[name["doc_id"]])
    return out.select(F.col(name["doc_id"]).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("pack", pack),
]

#: Tokenization and code lengths can't be told in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
