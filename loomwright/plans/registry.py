"""All queries of the reference's operators with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle where SQL can express it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, *tables: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer tasks than that: one
    large row group must not leave the texts of a table to one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_rows(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its rows are not: of the splits of a file only
    those that a row group's middle falls into have rows, however many they are.
    The count reads no column."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    n = held.agg(F.count("*").alias("parts"), F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return df.repartition(cores) if n.parts and (n.parts < cores or n.most * cores > 2 * n["all"]) else df


from loomwright.plans import audits, corpus, evaluation, serving, texts  # noqa: E402,F401
