"""The training-data operators and the pipeline on odd tables: clashing names, repeats, ties."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwright.llm import ann, bpe, exact_dedup, mixing, secret_scan, sharding, token_records, toxicity


def test_exact_dedup_keeps_different_texts_of_one_id(spark):
    rows = [(5, "x", "p"), (3, "y", "q"), (5, "y", "r"), (5, " x", "s"), (5, "x", "p"), (None, "n", "t"), (None, "n", "t"), (None, "y", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted((r.doc_id or 0, r.text, r.digest) for r in exact_dedup.deduplicate(docs).collect())
    assert got in ([(0, "n", "t"), (3, "y", "q"), (5, " x", "s"), (5, "x", "p")], [(0, "n", "t"), (3, "y", "q"), (5, "x", "p"), (5, " x", "s")])
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0
    twice = docs.select("doc_id", "text", F.lit(1).alias("body"), F.lit(2).alias("stays"), F.lit(3).alias("id"), F.lit(4).alias("salt"), F.lit(5).alias("c0"))
    assert exact_dedup.deduplicate(twice).columns == twice.columns and exact_dedup.deduplicate(twice).count() == 4


def spread(spark, sources, rows=6000):
    return spark.range(rows).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("host"), F.col("id") % sources)).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"),
    )


@pytest.mark.parametrize("sources", [5, 1500])
def test_mix_targets_equal_the_serial_ones(spark, sources):
    docs, spec = spread(spark, sources), mixing.MixSpec()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    names = sorted(sizes)
    want = dict(zip(names, mixing.targets([sizes[n] for n in names], spec), strict=True))
    rows = mixing.assign(docs, spec).collect()
    taken = dict.fromkeys(names, 0)
    for r in rows:
        assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - want[r.source]) < 1e-6 and len(r.mix_shards) <= 2
        taken[r.source] += r.mix_size * len(r.mix_shards)
    assert len(rows) == docs.count() and all(abs(taken[n] - want[n]) <= 17 for n in names)
    assert {s for r in rows for s in r.mix_shards} == set(range(spec.shards))


def test_mix_resolves_a_source_among_many(spark):
    rows = spread(spark, 3000, 40000)
    hot = mixing.assign(rows).where("source = 'hot'").agg(F.sum(F.col("mix_size") * F.size("mix_shards")).alias("t"), F.max("mix_target").alias("w")).first()
    assert abs(hot.t - hot.w) <= 17


def test_mix_with_clashing_names(spark):
    docs = spread(spark, 4, 300).select("*", *(F.lit(1).alias(c) for c in ("mix_shard", "mix_size", "block", "words", "shards", "size", "c0")))
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == mixing.assign(docs).agg(F.sum(F.size("mix_shards"))).first()[0]
    assert mixing.assign(docs).columns == [c for c in docs.columns if c != "mix_size"] + ["mix_size", "mix_source_size", "mix_target", "mix_shards"]
    repeated = spread(spark, 4, 60).withColumn("doc_id", F.lit(7)).withColumn("source", F.lit(None).cast("string"))
    assert mixing.assign(repeated).count() == 60


def test_toxicity_with_odd_rows_and_names(spark):
    texts = [f"good word number{i % 9} here" for i in range(80)] + [f"vexor bad number{i % 9} here" for i in range(20)] + [None, "", "12 34", "vexor bad " * 5000]
    rows = [(i, t, "x", 0.5, True) for i, t in enumerate(texts)] + [(3, None, "x", 0.5, True), (99, "vexor bad", "x", 0.5, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p string, p_toxic double, toxic boolean")
    labels = [(i, 1, int(i >= 80)) for i in range(100)] + [(99, 1, 1), (5, None, None), (None, 1, 1), (4000, 0, 1)]
    chain = toxicity.production_chain(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, chain)
    assert got.columns == ["doc_id", "text", "p", "p_low_quality", "p_toxic", "toxic"]
    bad = sorted(r.doc_id for r in got.where("toxic").collect())
    assert bad == [*range(80, 100), 99, 103]
    assert toxicity.reject(docs, chain).count() == len(rows) - 22 and toxicity.reject(docs, chain).where("doc_id = 3").count() == 2
    assert toxicity.reject(docs, chain).columns == docs.columns


def test_toxicity_sparse_rows_equal_dense_ones():
    rng = np.random.default_rng(0)
    hits = [np.flatnonzero(rng.random(20) < p) for p in (0, 0.2, 0.5, 0, 1.0)]
    x = toxicity.Rows(hits, rng.random(20)).wider(rng.random(5))
    dense = np.zeros((5, 22))
    for i, h in enumerate(hits):
        dense[i, h] = x.scale[h]
    dense[:, 20], dense[:, 21] = x.dense[:, 0], 1
    w, r = rng.random(22), rng.random(5)
    assert np.allclose(x.times(w), dense @ w) and np.allclose(x.back(r), dense.T @ r)
    assert np.allclose(x.part(np.array([1, 4])).times(w), (dense @ w)[[1, 4]])


@pytest.fixture()
def corpus(spark, tmp_path):
    """A small corpus with every odd row, and what each stage must keep of it."""
    r = np.random.default_rng(5)
    word = lambda: "w" + str(r.integers(0, 5000))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(60)
    texts = {i: text(30) for i in range(1, 121)}
    toxic = {i: f"{text(20)} vexoria {text(3)} grumbat" for i in range(121, 161)}
    near = {200: base, 201: base + " tail", 202: base + " other end"}
    odd = {300: None, 301: "", 302: " ", 303: base, 304: texts[1].replace(" ", "  "), 305: "x " * 20000}
    rows = [(i, t, "en", ["b", "a", None][i % 3], 1, "g") for i, t in (texts | toxic | near | odd).items()]
    rows += [(1, texts[1], "en", "b", 1, "g"), (2, "another text of the same id here", "en", "b", 1, "g"), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in (*range(1, 101), *range(121, 151))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_stage_by_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    ids = lambda df: sorted(r.doc_id if r.doc_id is not None else -1 for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "jaccard_join", "mix_sources", "bpe_encode_decode"]
    one = stages["toxicity"](spark, docs, corpus)
    assert ids(one) == sorted([*range(1, 121), 200, 201, 202, *range(300, 306), 1, 2, -1]) and one.columns == docs.columns
    two = stages["exact_dedup"](spark, one, corpus)
    assert ids(two) == sorted([*range(1, 121), 200, 201, 202, 300, 302, 305, 2]) and two.columns == docs.columns
    three = stages["jaccard_join"](spark, two, corpus)
    assert ids(three) == sorted([*range(1, 121), 200, 300, 302, 305, 2]) and three.columns == docs.columns
    four = stages["mix_sources"](spark, three, corpus)
    assert set(ids(four)) <= set(ids(three)) and max(ids(four).count(i) for i in ids(three)) <= 4 and four.columns == docs.columns
    five = stages["bpe_encode_decode"](spark, four, corpus)
    assert ids(five) == ids(four) and five.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for f in stages.values():
        assert f(spark, docs.limit(0), corpus).count() == 0
    assert corpus_pipeline.run(spark, corpus).count() == len(ids(four))


def test_nearest_with_repeated_ids_and_exactly(spark):
    x = np.random.default_rng(7).standard_normal((300, 16))
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(x)] + [(1, [9.0] * 16, "b", 2)] * 6 + [(50, x[50].tolist(), "c", 3), (50, [9.0] * 16, "c", 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string, dim int")
    smallest = {i: v for i, v in enumerate(x)}
    for i in (1, 50):
        smallest[i] = np.array(min([x[i].tolist(), [9.0] * 16]))
    u = np.array([smallest[i] / np.linalg.norm(smallest[i]) for i in range(300)])
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, coverage=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 300, 50):
        s = u @ u[q]
        s[q] = -2
        assert [v for _, v, _ in sorted(got[q])] == np.lexsort((np.arange(300), -s))[:5].tolist()


def test_nearest_recall_on_the_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    ids, x = np.array(table["vec_id"]), np.array(table["embedding"], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in ann.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[i] = -2
        hits += len(found[ids[i]] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
        total += 5
    assert hits >= 0.9 * total


@pytest.mark.parametrize("items", [1 << 16, 40])
def test_shards_of_many_levels_and_odd_rows(spark, monkeypatch, items):
    monkeypatch.setattr(sharding, "ITEMS", items)
    monkeypatch.setattr(sharding, "CELL_GROUPS", 64)
    rows = [(i, f"doc {i % 900} " * (i % 30 + 1), 1, "x") for i in range(2000)] + [(7, None, 1, "x"), (7, "", 1, "x"), (None, "n", 1, "x")] + [(9, "", 1, "x")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, digest string")
    got = sharding.shard_by_bytes(df).collect()
    assert len(got) == len(rows)
    where, sizes = {}, [0] * 24
    for r in got:
        assert where.setdefault((r.text_crc32, r.size), r.shard) == r.shard
        sizes[r.shard] += r.size
    assert where[zlib.crc32(b""), 8] is not None and max(sizes) - min(sizes) <= max(max(sizes) // 50, 402 * 8 + 400)
    for k in range(24):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_records_with_extreme_null_and_repeated_ids(spark):
    low = -(1 << 63)
    rows = [(low, "lowest"), (None, "b"), (None, None), (3, "two"), (3, "one"), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit(1)).withColumn("tokens", F.lit(2))
    root = token_records.fresh_root(spark)
    index = token_records.write_records(df, root, public_tokenizers.path("word_bpe_49k.json"), 2)
    got = sorted(token_records.read_records(spark, root, index).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, low, 3, 3, 3] and got[0].n_tokens == 1
    assert token_records.unpacked(token_records.packed(low, np.array([1]), 2))[0] == low


def test_scans_of_odd_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    key = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    df = spark.createDataFrame([(1, key, 1), (1, key, 1), (2, "word " * 50000 + key, 1), (None, None, 1)], "doc_id long, text string, p int")
    got = secret_scan.scan(df, path).collect()
    assert len(got) == 4 and sorted(len(r.findings or []) for r in got) == [0, 1, 1, 1]
    assert secret_scan.scan(df.limit(0), path).count() == 0
    twice = df.select("doc_id", "text", F.lit(1).alias("rows"), F.lit(2).alias("n"))
    assert bpe.encode(twice, public_tokenizers.path("byte_bpe_50k.json")).count() == 4
