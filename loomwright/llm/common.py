"""Text expressions, shared storage and Arrow batching that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
WHITE = "[\\x20\\x09-\\x0D]+"
#: Whether a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of one Arrow batch: long texts must not pile up in a Python worker.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the
    session, by its full address. Only where it is unset and the master is
    local, as in tests, a local folder is made and set for the session too."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loomwright-')}")
        return sc._jsc.sc().getCheckpointDir().get()
    return qualified(spark, root)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Spark reads it by: a path
    without a scheme is one of the default file system, not of a local disk."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def stored(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder, read it
    back. The path goes to ``scratch``, for :func:`discard`. Nothing reads the
    shuffle files of the write again, so they go with it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables that nothing depends on any more."""
    for path in scratch:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    scratch.clear()


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns named by position, so that names of one's own clash with none."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def original(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns that :func:`positional` renamed, under their names in ``like``."""
    return df.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(like.columns)))


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes, for plans made from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def squeezed(text: Column) -> Column:
    """Every run of contract white space becomes one space; null becomes ''.

    Byte-wise replacements do the single characters; the pattern runs only on
    texts that hold two spaces in a row."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(out.contains("  "), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def word_count(text: Column) -> Column:
    """Number of runs of other than contract white space; null: 0."""
    one = F.trim(squeezed(text))
    gaps = F.octet_length(one) - F.octet_length(F.replace(one, F.lit(" "), F.lit("")))
    return F.when(one == "", F.lit(0)).otherwise(gaps + 1).cast("long")
