"""Sinks: JSON lines with sorted keys, publish-last manifests, journals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """One column ``value``: rows as JSON, keys sorted, nulls present."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """Spark's committer writes into a temporary folder and renames."""
    as_json(df).write.mode("overwrite").option("compression", compression).text(path)


def summary(df: DataFrame, name: str) -> DataFrame:
    """Rows, positives and an order-free digest of an output."""
    line = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    digest = F.hex(F.bit_xor(F.conv(F.substring(line, 1, 15), 16, 10).cast("long")))
    return df.agg(F.lit(name).alias("output"), F.count("*").alias("rows"), digest.alias("digest"))


def publish(outputs: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Write every output as Parquet and, only then, the manifest; a manifest of
    an earlier run is invalid from the first write on."""
    frames = list(outputs.items())
    spark = frames[0][1].sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    rows = None
    for name, df in frames:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        s = summary(spark.read.parquet(f"{path}/{name}"), name)
        rows = s if rows is None else rows.unionByName(s)
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return spark.read.json(f"{path}/_manifest")


def append_journal(scores: DataFrame, path: str, identity: str) -> None:
    """Append (row_index, column_index, value) of one identity; rows that the
    journal has already are left out, so a repeated append changes nothing."""
    spark = scores.sparkSession
    new = scores.withColumn("identity", F.lit(identity))
    try:
        old = spark.read.parquet(path).where(F.col("identity") == identity)
    except Exception as e:  # the journal's first append
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        new = new.join(old.select("row_index", "column_index"), ["row_index", "column_index"], "left_anti")
    new.write.mode("append").partitionBy("identity").parquet(path)


def read_journal(spark, path: str, identity: str) -> DataFrame:
    """The journal's rows; raises where an identity's rows are not contiguous from 0."""
    df = spark.read.parquet(path).where(F.col("identity") == identity)
    g = df.agg(F.count_distinct("row_index").alias("n"), F.max("row_index").alias("m")).first()
    if g.n and g.m + 1 != g.n:
        raise ValueError(f"journal of {identity} has gaps: {g.n} rows up to {g.m}")
    return df
