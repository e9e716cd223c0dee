"""The training-data operators: odd inputs, brute force, round trips."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import ann, bpe, components, exact_dedup, html_text, jaccard_join, mixing, secret_scan, sharding, token_records, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, block int, rep long"


def make(spark, texts, start=0):
    rows = [(start + i, t, None, ["b", "a", None][i % 3], None, "x", 1, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\t", "a", "a  b", "a b", "a\tb", "x " * 3000, "é́ 中文", "a", None, "one two three four", "ONE two Three four", "<|endoftext|> hi"]


def test_exact_dedup_classes_and_edges(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(make(spark, ODD)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), same[0] == i)
    assert exact_dedup.exact_groups(make(spark, [])).count() == 0
    kept = exact_dedup.deduplicate(make(spark, ODD).union(make(spark, ODD)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].kept)
    assert kept.columns == make(spark, []).columns


def test_exact_dedup_many_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = exact_dedup.exact_groups(df).where("group_size > 1").agg(F.count("*"), F.max("keep_id"), F.max("group_size")).first()
    assert tuple(rows) == (1000, 0, 1000)


def test_mix_targets_and_reruns(spark):
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"),
    )
    rows = mixing.assign(docs).collect()
    again = {r.doc_id: list(r.mix_shards) for r in mixing.assign(docs).collect()}
    assert len(rows) == 600 and all(again[r.doc_id] == list(r.mix_shards) for r in rows)
    by = {}
    for r in rows:
        assert len(r.mix_shards) <= 2
        t = by.setdefault(r.source, [0, r.mix_target, r.mix_source_size])
        t[0] += r.mix_size * len(r.mix_shards)
    assert abs(sum(t[1] for t in by.values()) - 1.5 * sum(t[2] for t in by.values())) < 1e-6
    for taken, target, size in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 40
    assert mixing.mixed(docs).count() == sum(len(s) for s in again.values())
    assert mixing.assign(make(spark, [])).count() == 0
    assert mixing.assign(make(spark, ODD)).count() == len(ODD)


def test_split_tree_is_exact():
    q = np.array([5, 0, 130, 77])
    tree = mixing.split_tree(q, 13, np.random.default_rng(1))
    assert tree.shape == (13, 4) and (tree.sum(axis=0) == q).all() and (tree >= 0).all()


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_differencing_balances(parts):
    sizes = np.random.default_rng(3).integers(1, 1000, 500)
    labels = sharding.difference(sizes, parts)
    sums = np.bincount(labels, weights=sizes, minlength=parts)
    assert sums.max() - sums.min() <= 30


def test_shards_keep_groups_and_slots(spark):
    texts = ["hot " * 9] * 300 + [f"doc {i} " * (i % 30 + 1) for i in range(600)] + [None, ""]
    rows = sharding.shard_by_bytes(make(spark, texts)).collect()
    assert len(rows) == len(texts)
    where = {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.grown_shard is None
        assert where.setdefault(t, r.shard) == r.shard
    for s in range(24):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(make(spark, [])).count() == 0


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE_BPE)


def random_texts(n, seed):
    r = random.Random(seed)
    letters = list("abcdefgh' \n\t  the don't éÉß中文İΣσς!?12_.,;") + ["<|endoftext|>", "\U0001f600", "\xa0", "\x1c", "\x85", "́", " ", "'re", "\r\n", "$$$"]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_the_library(byte_library):
    texts = random_texts(400, 1) + ["a" * 5000, "x" * 300 + " " * 50, "word " * 4000]
    own = bpe.tokenizer(BYTE_BPE)
    for t, ids in zip(texts, own.encode_batch(texts)):
        e = byte_library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == e
        assert own.decode(ids) == byte_library.decode(e, skip_special_tokens=False)


def test_bpe_segments_of_long_texts(byte_library, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", 50)
    texts = random_texts(60, 2) + ["Ab cd, " * 60]
    for t, ids in zip(texts, bpe.SpeculativeBpe(BYTE_BPE).encode_batch(texts)):
        assert ids.tolist() == byte_library.encode(t, add_special_tokens=False).ids


def test_bpe_frames(spark):
    rows = bpe.decode(bpe.encode(make(spark, ODD), BYTE_BPE), BYTE_BPE).collect()
    assert [r.decoded for r in sorted(rows, key=lambda r: r.doc_id)] == [t or "" for t in ODD]
    assert bpe.encode(make(spark, []), BYTE_BPE).count() == 0
    both = bpe.round_trip(make(spark, ODD), BYTE_BPE)
    assert both.columns == [*make(spark, []).columns, "ids", "decoded"]
    assert sorted((r.doc_id, r.ids, r.decoded) for r in both.collect()) == sorted((r.doc_id, r.ids, r.decoded) for r in rows)
    assert both.select("doc_id", F.size("ids"), F.length("decoded"))._jdf.queryExecution().executedPlan().toString().count("encode_and_decode") == 1


def test_token_records_round_trip(spark):
    lib = Tokenizer.from_file(WORD_BPE)
    texts = ODD + random_texts(60, 5)
    root = token_records.fresh_root(spark)
    index = token_records.write_records(make(spark, texts), root, WORD_BPE, 2)
    rows = sorted(token_records.read_records(spark, root, index).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = index.where("doc_id = 5").first()
    assert token_records.fetch(root, one.file, one.offset)[1].tolist() == lib.encode(texts[5], add_special_tokens=False).ids + [2]
    empty = token_records.write_records(make(spark, []), token_records.fresh_root(spark), WORD_BPE, 2)
    assert empty.count() == 0


def test_token_records_detect_damage():
    frame = token_records.framed(token_records.packed(None, np.array([1, 2, 70000]), 4))
    assert [token_records.unpacked(p)[0] for _, p in token_records.frames(pa.BufferReader(frame), "f")] == [None]
    for at in (3, 9, 20, len(frame) - 1):
        bad = bytearray(frame)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_records.frames(pa.BufferReader(bytes(bad)), "f"))


def brute_components(texts, k, percent):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, k, percent):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(30, 120))] for _ in range(12)]
    shared = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for b in base:
        for _ in range(14):  # a family of copies, edited more and more
            w = list(b)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w + (shared if r.random() < 0.3 else [])))
    texts += ODD + ["a b", "A  B", " ".join(shared)] * 2
    rows = sorted(jaccard_join.similar_classes(make(spark, texts), k, percent).collect(), key=lambda x: x.doc_id)
    sizes, found = brute_components(texts, k, percent)
    assert [x.n_shingles for x in rows] == sizes
    assert [x.component_id for x in rows] == found


def test_jaccard_join_empty(spark):
    assert jaccard_join.similar_classes(make(spark, [])).count() == 0
    assert [x.component_id for x in jaccard_join.similar_classes(make(spark, [None, None, ""])).orderBy("doc_id").collect()] == [0, 1, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 30), (50, 30), (7, 7), (1, 0)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 40: 30, 50: 30}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity_chain_held_out(spark):
    r = random.Random(4)
    words = ["".join(r.choice("aeioubcdfgl") for _ in range(6)) for _ in range(300)]
    bad = ["vexoria", "vexoling", "grumbat"]
    texts, toxic = [], []
    for i in range(600):
        w = [r.choice(words) for _ in range(r.randint(20, 200))]
        toxic.append(int(i % 6 == 0))
        if toxic[-1]:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "en", "um"]))
        texts.append(" ".join(w))
    docs = make(spark, texts + ODD)
    labels = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(toxic) if i < 400], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in toxicity.score(docs, toxicity.production_chain(docs, labels)).collect()}
    right = sum(out[i].toxic == bool(t) for i, t in enumerate(toxic) if i >= 400)
    assert right >= 195 and not any(out[600 + i].toxic for i in range(len(ODD)))
    none = toxicity.production_chain(docs, labels.limit(0))
    assert not toxicity.score(docs, none).where("toxic").count()
    assert toxicity.score(make(spark, []), none).count() == 0


def test_html_main_text():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><!-- c --><div class='ad'>Buy now.</div>"
        "<article><h1>Head &amp; line</h1><p><b>First, a long   paragraph; with text.<br><p>Short.<ul><li>one<li>two</ul></article>"
        "<section id=comments><p>Nice article, really nice article!</p></section><aside>More</aside><form>mail</form><footer>&copy; us</footer>"
    )
    assert html_text.main_text(page) == "Head & line\n\nFirst, a long paragraph; with text.\n\nShort.\n\none\n\ntwo"
    for odd in (None, "", "<p>", "<article", "<<<>>>", "</b></p>", "<div>" * 3000, "a < b"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("plain &eacute; text") == "plain é text"


def test_html_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "<p>Hi there.</p>", None)], "page_id long, html string, text string")
    assert [r.text for r in html_text.extract(df).orderBy("page_id").collect()] == ["", "Hi there."]


def test_secret_scan(spark):
    words = secret_scan.dictionary(WORD_BPE)
    data = secret_scan.sample_findings(3000)
    forest = secret_scan.fit_forest(data[:2000], words)
    right = 0
    for path, text, start, end, label in data[2000:]:
        x = np.array([secret_scan.features(path, text, start, end, next((k for s, e, k in secret_scan.candidates(text) if s <= start < e), "opaque"), words)])
        right += bool(forest.predict(x)[0] >= 0.5) == label
    assert right >= 970
    rows = secret_scan.scan(make(spark, [*ODD, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962"]), WORD_BPE).orderBy("doc_id").collect()
    assert all(not r.findings for r in rows[:-2])
    assert rows[-2].findings[0].secret and rows[-2].findings[0].start == 11 and not any(f.secret for f in rows[-1].findings)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 32))
    x[300:420] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(2000, None, 0), (2050, [0.0] * 32, 0), (2100, [float("nan")] * 32, 0), (2150, [], 0), (2200, [1.0, 2.0], 0), (2201, [2.0, 4.0], 0), (2250, [None] * 32, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, list int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 900, 50):
        s = u @ u[q]
        s[q] = -2
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        hit += len(set(best.tolist()) & {v for v, _ in got[q].values()})
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - c) < 1e-12 for v, c in got[q].values())
    assert hit >= 0.9 * 18 * 5
    assert [v for v, _ in (got[0][k] for k in range(1, 6))] == [300, 301, 302, 303, 304]
    assert got[2200] == {1: (2201, pytest.approx(1.0))}
    assert not {2000, 2050, 2100, 2150, 2250} & set(got)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
