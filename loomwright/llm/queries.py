"""Registered queries of the training-data operators: thin digests of their rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import ann, bpe, html_text, jaccard_join, mixing, secret_scan, sharding, token_records, toxicity
from loomwright.llm.exact_dedup import exact_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op9_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
    g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id,
                 count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256 FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


@_query("op4_bpe_encode_decode")
def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_digest(bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), path))


def bpe_digest(coded: DataFrame) -> DataFrame:
    """The contract's columns from rows with ``doc_id``, ``ids`` and ``decoded``."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@_query("op1_mix_sources")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.assign(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.size("mix_shards")).alias("taken"),
        F.col("mix_shards").alias("shards"),
    )


@_query("op7_shard_bytes")
def op7_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op8_token_records")
def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    root = token_records.fresh_root(spark)
    index = token_records.write_records(docs, root, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_records.read_records(spark, root, index)


@_query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)


@_query("op3_toxicity_chain")
def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.production_chain(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).drop("text")


@_query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


@_query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secret_scan.scan(docs, public_tokenizers.path("word_bpe_49k.json"), path=F.col("source")).select("doc_id", "findings")
    secrets = F.filter("findings", lambda f: f["secret"])
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(secrets).cast("long").alias("n_secrets"),
        F.transform(secrets, lambda f: F.concat_ws(":", f["kind"], f["start"], f["length"])).alias("secrets"),
    )
