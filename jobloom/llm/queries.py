"""Queries over the given tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import decontaminate as dc
from jobloom.llm import jaccard_join, oracles, packing, secrets, sharding, topk_search, toxicity, url_filter, warc
from jobloom.llm import language_id as li
from jobloom.llm.common import load, staging_path


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.scaled(load(spark, sf_dir, "embeddings"))
    return topk_search.search(vectors, F.col("id") % 100 == 0, k=10)


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "warc")
    warc.write(load(spark, sf_dir, "pages"), path, min_bytes=0)
    out = warc.read(spark, path)
    return out.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "shards")
    sharding.write_shards(load(spark, sf_dir, "documents"), path, shards=40)
    out = sharding.read_shards(spark, path)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dc.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(load(spark, sf_dir, "documents"), keep=["doc_id"])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(load(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(li.fold_of("doc_id", 3) == 1, F.lit(False))
    model = li.fit(li.bounded_sample(docs.where(~held_out)))
    out = li.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(load(spark, sf_dir, "documents"), num=90, den=100, shingle=3)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held_out = F.coalesce(li.fold_of("doc_id", 4) == 2, F.lit(False))
    index = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "text").where(~held_out), labels.select("doc_id", "toxic"))
    out = toxicity.score(docs.select("doc_id", "text"), index, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_url_filter": op2_url_filter,
    "op3_warc": op3_warc,
    "op4_sharding": op4_sharding,
    "op5_decontaminate": op5_decontaminate,
    "op6_secrets": op6_secrets,
    "op7_pack": op7_pack,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_topk_search": oracles.OP1,
    "op2_url_filter": oracles.op2(URL_RULES),
    "op3_warc": oracles.OP3,
    "op5_decontaminate": oracles.OP5,
    "op9_jaccard_join": oracles.OP9,
}
