"""Append-only ledgers and journals: latest records, resumption, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def latest(df: DataFrame, keys: Sequence[str], seq: str, values: Sequence[str]) -> DataFrame:
    """The last record of each key, and how many there were."""
    return df.groupBy(*keys).agg(F.max(seq).alias(seq), *(F.max_by(v, seq).alias(v) for v in values), F.count("*").alias("attempts"))


def pending(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return jobs.join(done, list(keys), "left_anti")


def job_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def spent(df: DataFrame, keys: Sequence[str], seq: str, cost: Column) -> DataFrame:
    w = W.Window.partitionBy(*keys).orderBy(seq).rowsBetween(W.Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w))


def contiguity(df: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    n = F.count("*")
    return df.groupBy(*keys).agg(n.alias("completed"), (F.max(row) - F.min(row) + 1 == n).alias("contiguous"))


def missing_ranges(df: DataFrame, keys: Sequence[str], row: str, block: int = 1 << 16) -> DataFrame:
    """Gaps between rows. Ids fall into blocks, so the ordered window runs per
    block; only each block's ends meet in a window over all blocks."""
    b = df.select(*keys, row, F.floor(F.col(row) / block).alias("__b"))
    inner = W.Window.partitionBy(*keys, "__b").orderBy(row)
    gaps = b.select(*keys, F.col(row).alias("lo"), F.lead(row).over(inner).alias("hi"))
    ends = b.groupBy(*keys, "__b").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    outer = W.Window.partitionBy(*keys).orderBy("__b")
    between = ends.select(*keys, F.col("last").alias("lo"), F.lead("first").over(outer).alias("hi"))
    return gaps.unionByName(between).where("hi > lo + 1").select(*keys, (F.col("lo") + 1).alias("first_missing"), (F.col("hi") - 1).alias("last_missing"))


def assembled(df: DataFrame, key: str, order: Sequence[str], chunk: str) -> DataFrame:
    """Artifacts from chunks in order; one artifact is what a task gathers."""
    parts = F.array_sort(F.collect_list(F.struct(*order)))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[chunk]), "").alias("whole"), F.count("*").alias("chunks"))
