"""Tables that the queries share, and the same as SQL for their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators import corpus as C
from loomwright.plans.registry import load, spread, spread_rows

NORM_SQL = "trim(regexp_replace(replace(lower(text),'ß','ss'),'[ \\n]+',' ','g'))"

#: Per document the strict hash, as far as texts without invisible points and look-alikes need it.
STRICT_SQL = """
strict_chars AS (SELECT doc_id, string_split(strip_accents(text), '') AS l FROM documents),
strict_cut AS (SELECT doc_id, array_to_string(list_filter(l, lambda x, i: i <= 3 OR x <> l[i-1] OR x <> l[i-2] OR x <> l[i-3]), '') AS t FROM strict_chars),
strict AS (SELECT doc_id, sha256(trim(regexp_replace(replace(lower(t),'ß','ss'),'[ \\n]+',' ','g'))) AS sh FROM strict_cut)
"""


def hash_unit(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_unit_sql(key: str) -> str:
    return f"(('0x' || substr(sha256(CAST({key} AS VARCHAR)),1,8))::BIGINT / 4294967296.0)"


def _lineage() -> Column:
    return F.concat_ws("-", "source", F.col("doc_id") % 50)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their judgements, in the shape that ``canonical`` takes."""
    docs, labels = load(spark, sf_dir, "documents", "labels")
    known = F.col("toxic").isNotNull()
    return spread(docs).join(labels, "doc_id", "left").select(
        "text",
        F.when(known, F.lit(0)).alias("label"),
        "source",
        "lang",
        "doc_id",
        F.lit("all").alias("source_split"),
        F.col("doc_id").alias("source_id"),
        _lineage().alias("group_id"),
        F.when(~known, "uncertain").alias("security_label"),
        F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "not_toxic").otherwise("unknown").alias("toxicity"),
        F.when(known & (F.col("quality") == 0), "unverified").otherwise("source_annotation").alias("label_basis"),
    )


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.canonical(raw_rows(spark, sf_dir))
    return C.with_role(df, F.when(F.col("label").isNull(), "uncertain").otherwise("candidate"))


def unlabelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows of all documents as unjudged ones, for what no judgement
    bears on: the join with them would move every text."""
    (docs,) = load(spark, sf_dir, "documents")
    no_label, unsure = F.lit(None).cast("int").alias("label"), F.lit("uncertain").alias("security_label")
    split = F.lit("all").alias("source_split")
    return C.canonical(spread_rows(docs).select("text", no_label, "source", "doc_id", split, F.col("doc_id").alias("source_id"), _lineage().alias("group_id"), unsure))


CANONICAL_SQL = f"""
canon AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.source || ':' || d.doc_id AS id, d.source || '-' || (d.doc_id % 50) AS group_id,
         CASE WHEN l.doc_id IS NULL THEN NULL ELSE 0 END AS label,
         CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'not_toxic' ELSE 'unknown' END AS toxicity,
         CASE WHEN l.doc_id IS NULL THEN 'uncertain' WHEN l.toxic = 1 THEN 'harmful_non_injection' ELSE 'benign' END AS security_label,
         CASE WHEN l.doc_id IS NULL OR l.toxic = 1 THEN 1 ELSE 0 END AS routing_label,
         CASE WHEN l.doc_id IS NULL THEN 'uncertain' ELSE 'candidate' END AS source_role,
         CASE WHEN l.quality = 0 THEN 'unverified' ELSE 'source_annotation' END AS label_basis,
         {NORM_SQL} AS norm, sha256({NORM_SQL}) AS h
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a deterministic score that leans to the label."""
    docs, labels = load(spark, sf_dir, "documents", "labels")
    score = F.round(hash_unit(F.col("doc_id")) * 0.7 + F.col("toxic") * 0.3, 3)
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("toxic").alias("label"),
        score.alias("score"),
        "source",
        "lang",
        "text",
        F.when(F.col("doc_id") % 2 == 0, "direct_user").otherwise("untrusted_content").alias("channel"),
        F.concat_ws("-", "source", F.col("doc_id") % 7).alias("group_id"),
    )


SCORED_SQL = f"""
scored AS (
  SELECT d.doc_id, l.toxic AS label, round({hash_unit_sql("d.doc_id")} * 0.7 + l.toxic * 0.3, 3) AS score, d.source, d.lang, d.text,
         CASE WHEN d.doc_id % 2 = 0 THEN 'direct_user' ELSE 'untrusted_content' END AS channel, d.source || '-' || (d.doc_id % 7) AS group_id
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def norm_hash(text: Column) -> Column:
    return X.text_hash(text)
