"""A training-data pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns the columns of ``documents``; the last returns the digests of
the encoded texts. Between stages the rows are written as Parquet and reread.
Columns besides doc_id, text and source pass through whatever their names. An
empty table leaves every stage empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from loomwright.llm.common import original, positional, stored
from loomwright.llm.queries import bpe_digest

#: Near duplicates: five-word shingles, at least 80 % in common.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: No SQL expresses a trained chain or seeded draws.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labelled ones, does not reject.

    Null, empty and wordless texts have no evidence and stay; every row of a
    repeated id is judged by its own text; without labels nothing is rejected."""
    chain = toxicity.production_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, chain)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id, a null id last; null and
    empty texts are equal. Rows of one id with different texts all stay."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the one with the smallest id.

    Texts without words and rows without an id are near nothing and stay. An id
    that several rows share does not tell which of them is the copy, so they
    stay too, though smaller and larger ids are judged against them."""
    groups = jaccard_join.similar_classes(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT)
    gone = groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("first"))
    gone = gone.where("rows = 1 AND doc_id <> first").select(F.col("doc_id").alias("c_gone"))
    rows = positional(docs)
    own = F.col(rows.columns[docs.columns.index("doc_id")])
    return original(rows.join(gone, own == F.col("c_gone"), "left_anti"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn, never over twice; a null
    source is a source, and texts without words are drawn with their block."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and the decoded texts, one row
    per row of ``docs``; null and empty texts have no tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_digest(bpe.round_trip(docs.select("doc_id", "text"), path))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix),
    ("bpe_encode_decode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
