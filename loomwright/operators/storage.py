"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that a task that handles whole texts holds at once.
TEXT_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "256",
}


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the batches of what is computed inside, whatever the texts' length;
    after it the session has its own bounds again."""
    kept = {k: spark.conf.get(k) for k in TEXT_BATCHES}
    for k, v in TEXT_BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where it is
    unset and the master is local, as in tests."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root or have.isDefined():
        return root or have.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loomwright-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: what is costly is computed once."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
