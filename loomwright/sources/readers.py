"""Scans: typed, validated reads of the file formats that corpora come in.

Readers take an explicit schema and fail on rows that break it. Digests of
whole files are computed where the files are, by Spark.
"""

from __future__ import annotations

import bz2
import gzip
import io
import re
import tarfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_digests(spark: SparkSession, path: str, expected: Mapping[str, str]) -> None:
    """Raise unless each named file exists with its digest."""
    have = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in file_digests(spark, path).collect()}
    wrong = sorted(n for n, d in expected.items() if have.get(n) != d)
    if wrong:
        raise ValueError(f"digest mismatch: {', '.join(wrong)}")


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines, plain or compressed by suffix; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of which blank ones are skipped; broken lines give nulls."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that is one JSON array (or one object): a row per item."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_object_items(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A file that is one object: a row per (key, value) of DDL type ``value``."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def csv_rows(spark: SparkSession, path: str, required: Sequence[str], sep: str = ",") -> DataFrame:
    """CSV or TSV with a header, quoted line breaks and at least the required columns."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).option("maxCharsPerColumn", 10 << 20).csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return require_columns(df, required)


def parquet_rows(spark: SparkSession, path: str | Sequence[str], required: Sequence[str], exact: bool = False) -> DataFrame:
    """Parquet of which only the required columns are read."""
    paths = [path] if isinstance(path, str) else list(path)
    return require_columns(spark.read.parquet(*paths), required, exact).select(*required)


def require_columns(df: DataFrame, required: Sequence[str], exact: bool = False) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    stray = [c for c in df.columns if c not in required] if exact else []
    if missing or stray:
        raise ValueError(f"missing columns {missing}, unexpected columns {stray}")
    return df


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, compressed or not (bz2 is split)."""
    return spark.read.text(path)


def marked_json_lines(spark: SparkSession, path: str, marker: str, ids: DataFrame, id_field: str, schema: str) -> DataFrame:
    """JSON lines of known ids: lines without the cheap marker are never parsed."""
    lines = spark.read.text(path).where(F.col("value").contains(marker))
    rows = lines.withColumn("id", F.get_json_object("value", f"$.{id_field}")).join(ids, "id", "left_semi")
    return rows.select("id", F.from_json("value", schema).alias("r"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)


def joined_by_stem(spark: SparkSession, left: str, right: str, left_schema: str, right_schema: str) -> DataFrame:
    """Two folders of JSON files, matched by file name without suffix."""
    read = lambda p, s: spark.read.schema(s).option("multiLine", True).json(p).withColumn("stem", stem(F.input_file_name()))
    return read(left, left_schema).join(read(right, right_schema), "stem")


def archive_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(archive, member, content) of the members of tar archives (plain, gz,
    bz2) whose name matches; archives are opened where they were read."""
    want = re.compile(pattern)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and want.search(m.name):
                            body = tar.extractfile(m).read()
                            yield pa.RecordBatch.from_pydict({"archive": [name], "member": [m.name], "content": [body]}, schema=pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())]))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, "archive string, member string, content binary")


def decompressed(content: bytes, name: str) -> bytes:
    return gzip.decompress(content) if name.endswith(".gz") else bz2.decompress(content) if name.endswith(".bz2") else content


def unique_per_source(rows: DataFrame, source: str = "source", key: str = "id") -> DataFrame:
    """``rows``, or an error that names an id which a source holds twice. The
    check is a grouped count that runs with the rows' own job."""
    seen = rows.groupBy(source, key).agg(F.count("*").alias("__n"))
    ok = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate id "), F.col(source), F.lit(":"), F.col(key))).cast("boolean")).otherwise(True)
    return rows.join(seen.where(ok).select(source, key), [source, key])


def check_counts(rows: DataFrame, expected: Mapping[str, int], source: str = "source") -> None:
    have = {r[source]: r.n for r in rows.groupBy(source).agg(F.count("*").alias("n")).collect()}
    wrong = {s: (n, have.get(s, 0)) for s, n in expected.items() if have.get(s, 0) != n}
    if wrong or set(have) - set(expected):
        raise ValueError(f"row counts differ: {wrong}, unknown sources {sorted(set(have) - set(expected))}")


def yaml_list(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A YAML list of flat mappings (strings, numbers, booleans) as rows."""
    items: list[dict] = []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        m = re.match(r"^(- |\s+)([\w-]+):\s*(.*)$", body)
        if not m:
            if body.strip() and not body.startswith("#"):
                raise ValueError(f"no flat YAML mapping: {line!r}")
            continue
        if m[1] == "- ":
            items.append({})
        v = m[3].strip().strip("\"'")
        items[-1][m[2]] = {"true": True, "false": False, "null": None, "": None}.get(v, int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d+\.\d+", v) else v)
    return spark.createDataFrame([tuple(i.get(f.name) for f in T._parse_datatype_string(schema).fields) for i in items], schema)
