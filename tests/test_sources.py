"""Readers, sinks and streams on files of their own."""

import bz2
import gzip
import hashlib
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from loomwright.sources import readers, sinks
from loomwright.streaming import ledgers


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(b'{"x": 3}\n'))
    assert sorted(r.x for r in readers.json_lines(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl.gz")], "x int").collect()) == [1, 2, 3]
    (tmp_path / "bad.jsonl").write_text('{"x": 1\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "x int").collect()
    (tmp_path / "o.json").write_text('{"k": {"v": 1}, "l": {"v": 2}}')
    assert {r.key: r.value.v for r in readers.json_object_items(spark, str(tmp_path / "o.json"), "struct<v:int>").collect()} == {"k": 1, "l": 2}


def test_digests(spark, tmp_path):
    (tmp_path / "f.txt").write_text("hello")
    readers.verify_digests(spark, str(tmp_path), {"f.txt": hashlib.sha256(b"hello").hexdigest()})
    with pytest.raises(ValueError, match="digest mismatch"):
        readers.verify_digests(spark, str(tmp_path), {"f.txt": "0" * 64})


def test_csv_and_archives(spark, tmp_path):
    (tmp_path / "c.csv").write_text('a,b\n1,"x\ny"\n')
    assert readers.csv_rows(spark, str(tmp_path / "c.csv"), ["a", "b"]).first().b == "x\ny"
    with pytest.raises(ValueError, match="missing columns"):
        readers.csv_rows(spark, str(tmp_path / "c.csv"), ["z"])
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name in ("d/one.json", "d/two.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"{}"))
    (tmp_path / "t.tar.gz").write_bytes(buffer.getvalue())
    assert [r.member for r in readers.archive_members(spark, str(tmp_path / "t.tar.gz"), r"\.json$").collect()] == ["d/one.json"]
    (tmp_path / "l.bz2").write_bytes(bz2.compress(b"a\nb\n"))
    assert readers.text_lines(spark, str(tmp_path / "l.bz2")).count() == 2


def test_unique_ids(spark):
    df = spark.createDataFrame([("s", 1), ("s", 1)], "source string, id int")
    with pytest.raises(Exception, match="duplicate id"):
        readers.unique_per_source(df).collect()
    assert readers.unique_per_source(df.distinct()).count() == 1


def test_yaml(spark):
    rows = readers.yaml_list(spark, "- name: a\n  n: 2\n- name: 'b'\n  n: 3 # c\n", "name string, n int").collect()
    assert [(r.name, r.n) for r in rows] == [("a", 2), ("b", 3)]


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "b int, a string")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert [json.loads(x) for x in lines] == [{"a": "x", "b": 2}, {"a": None, "b": 1}] and lines[0].startswith('{"a"')
    m = {r.output: r for r in sinks.publish({"one": df, "two": df.limit(0)}, str(tmp_path / "p")).collect()}
    assert (m["one"].rows, m["two"].rows) == (2, 0)


def test_journal(spark, tmp_path):
    path = str(tmp_path / "journal")
    rows = spark.range(4).select(F.col("id").alias("row_index"), F.lit(0).alias("column_index"), F.rand(1).alias("value"))
    sinks.append_journal(rows, path, "x")
    sinks.append_journal(rows, path, "x")
    assert sinks.read_journal(spark, path, "x").count() == 4
    sinks.append_journal(rows.where("row_index = 3").withColumn("row_index", F.lit(9).cast("long")), path, "x")
    with pytest.raises(ValueError, match="gaps"):
        sinks.read_journal(spark, path, "x")


def test_streams(spark, tmp_path):
    events = spark.range(40).select((F.col("id") % 20).alias("job"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(1.0).alias("value"), F.lit("a").alias("kind"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = ledgers.event_stream(spark, str(tmp_path / "in"))
        q = ledgers.sink_new_rows(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["job"])
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    q = ledgers.windowed_counts(ledgers.event_stream(spark, str(tmp_path / "in")), "ts", "kind").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) s from w").first().s == 40
