"""Exact deduplication by skew-safe combining.

Three stages, each of which compares digests *and* whole contents because the
normalised text is part of every grouping key:

1. each partition deduplicates its own rows (the map-side combine of stage 2);
2. salted digest groups merge: key (digest, text, salt);
3. the winners of the salts combine globally: key (digest, text).

A group that holds a third of all rows therefore reaches stage 3 as at most
``salts`` rows. The way back to the documents merges nothing: it finds a
document's class by the digest of its text and by the salt or the id that
stays, so no task ever gathers all copies of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import original, positional, squeezed, stored

#: Salts of one digest group.
SALTS = 32  # at most 62: a group's salts are one bit mask


def _rows(docs: DataFrame, id_col: str, text_col: str, salts: int, *kept: Column) -> DataFrame:
    """``kept`` columns with doc_id, salt, body (the normalised text) and its digest."""
    salt = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(salts)).cast("int")
    body = squeezed(F.col(f"`{text_col}`"))
    rows = docs.select(*kept, F.col(f"`{id_col}`").alias("doc_id"), salt.alias("salt"), body.alias("body"))
    return rows.withColumn("digest", F.sha2("body", 256))


def _winners(rows: DataFrame) -> DataFrame:
    """Per class of equal texts: digest, keep_id, group_size and the salts that it holds."""
    salted = rows.groupBy("digest", "body", "salt").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    present = F.bit_or(F.expr("shiftleft(1L, salt)"))  # a fixed-size buffer: stays a hash aggregate
    return salted.groupBy("digest", "body").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"), present.alias("mask")).drop("body")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to one another. Of equal texts the smallest
    id stays; several rows that share one id and text are copies too, of which
    all carry the id that is kept. An empty table gives no rows; extra columns
    are ignored. A null id sorts behind all others and is kept only when its
    group has no other."""
    rows = _rows(docs, id_col, text_col, salts)
    # From here on a class is known by its digest; (digest, salt) meets at most one row.
    salts_of = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit("mask", s) == 1)
    classes = _winners(rows).select("digest", "keep_id", "group_size", F.explode(salts_of).alias("salt"))
    slim = rows.select("doc_id", "digest", "salt")
    return slim.join(classes, ["digest", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` with one row of each class of equal texts, all its columns unchanged.

    It is the row with the smallest id, a null id behind all others; of several
    rows with that id and equal texts an arbitrary one. Rows that share an id
    but not the text are different documents and both stay. Null and empty
    texts are equal to one another. An empty table gives no rows; columns of
    any name, such as ``digest``, come back as they were. The classes are
    stored first, so the rows themselves move once, by (digest, id)."""
    known = positional(docs)
    at = dict(zip(docs.columns, known.columns, strict=True))
    rows = _rows(known, at[id_col], at[text_col], salts, *map(F.col, known.columns))
    key = lambda c: [F.col(c).isNull().alias("unnamed"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id")]
    stays = stored(_winners(rows).select("digest", *key("keep_id")), "dedup-classes")
    on = ["digest", "unnamed", "id"]  # one partitioning for the join and for what follows
    kept = rows.select("*", *key("doc_id")).drop("body").join(stays, on, "left_semi").dropDuplicates(on)
    return original(kept, docs)
