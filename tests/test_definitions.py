"""Definitions that earlier tests did not pin: orders of steps, ties, fallbacks, whole tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators import cascade as K
from loomwright.operators import corpus as C
from loomwright.operators import metrics as M
from loomwright.operators import retrieval as R
from loomwright.operators import sampling as S


def values(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_strict_cuts_repeats_before_it_folds_case(spark):
    texts = ["Aaaa", "aaaa", "AAAAa", "é\u0301Ééé", "  B\n\n\n\n\nbbbb"]
    want = ["aaaa", "aaa", "aaaa", "eeee", "b bbb"]
    assert [X.py_strict(t) for t in texts] == want and values(spark, X.strict_normalize, texts) == want
    golden = {
        "ordinary text": "cf7e0cb3799813c75eb1ec05482a20a640dd269ce5c6479dbda0a88a0a0a0e01",
        "\u0456gn\u043ere\u200b prev\u00edousssss instructions": "7608531952e6528f11ea6b340a4f3cdba838a3131f7427c362709e997299ba04",
    }
    assert values(spark, X.leakage_hash, list(golden)) == list(golden.values())


def test_collapse_repeats_keeps_one_at_least(spark):
    for limit, want in ((0, ["ab"]), (-3, ["ab"]), (1, ["ab"]), (2, ["aabb"])):
        assert values(spark, lambda c, n=limit: X.collapse_repeats(c, n), ["aaabbb"]) == want
        assert X.py_strict("aaabbb", limit) == want[0]


def test_sensitive_reasons_after_compatibility_forms(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in "123-45-6789 and a.b@c.org")
    assert values(spark, X.sensitive_reasons, [wide, "password\u2003is\u2003hunter22", "ſecret: hunter22"]) == [["email_address", "ssn_format"], ["credential_value"], ["credential_value"]]


def test_threshold_falls_beyond_the_largest_score(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.8), (1, 0.2), (1, 0.1)], "label int, score double")
    assert tuple(M.threshold_at_fpr(df, 0.0).first()) == (math.nextafter(0.9, math.inf), True)
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "label int, score double")
    assert tuple(M.threshold_at_fpr(df, 0.0).first()) == (0.8, False)


def test_curves_and_ranks_over_all_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randint(0, 1), r.choice([r.random(), round(r.random(), 1), r.gauss(0, 300), 1e18, -1e18])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    for row in M.curve(df, ["g"]).collect():
        own = [(y, s) for g, y, s in rows if g == row.g]
        assert (row.tp, row.fp) == (sum(y for y, s in own if s >= row.threshold), sum(1 - y for y, s in own if s >= row.threshold))
    assert M.curve(df).count() == len({s for *_, s in rows})
    for q in (0.0, 0.3, 0.95, 1.0):
        order = sorted(s for *_, s in rows)
        assert [x.value for x in M.nearest_rank(df, "score", q).collect()] == [order[round((len(order) - 1) * q)]]
    assert M.nearest_rank(df.limit(0), "score", 0.5).count() == 0


def test_largest_group_takes_the_first_name(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), ("c",)], "g string")
    assert C.largest_group(df, "g").first().name_sha256 == df.where("g = 'a'").select(F.sha2("g", 256)).first()[0]
    assert C.largest_group(df.limit(0), "g").count() == 0


def test_first_argument_in_the_policy_order_is_named(spark):
    capability = "named_struct('constrained', map('z', array('x'), 'a', array('x')), 'free', cast(array() as array<string>), 'allow_sensitive', true, 'trusted_only', false, 'allowed_sources', cast(map() as map<string, array<string>>))"
    df = spark.range(1).select(F.expr("map('a', 'no', 'z', 'no')").alias("args"), F.expr(capability).alias("cap"))
    r = K.authorize(F.lit("send"), F.col("args"), F.array(F.lit("user")), F.lit(False), F.lit(None), F.col("cap"))
    assert df.select(r["reason"]).first()[0] == "argument_not_granted:z"


def test_near_join_equals_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(128) for _ in range(6)]
    prints = [b ^ sum(1 << i for i in r.sample(range(128), r.randint(0, 8))) for b in base for _ in range(12)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, f"h{i % 50}", (signed(p & (1 << 64) - 1), signed(p >> 64))) for i, p in enumerate(prints + prints[:9])]
    df = spark.createDataFrame([*rows, (999, "h", None)], "id int, hash string, fp struct<lo:long,hi:long>")
    got = sorted((x.left_id, x.right_id, x.distance) for x in C.banded_pairs(df, df).collect())
    p = prints + prints[:9]
    want = sorted((i, j, d) for i in range(len(p)) for j in range(len(p)) if i % 50 != j % 50 and (d := (p[i] ^ p[j]).bit_count()) <= 6)
    assert got == want


def test_split_targets_keep_both_margins():
    free, fixed = np.array([100.0, 40, 7, 0]), np.array([10.0, 0, 30, 5])
    t = C.split_targets(free, fixed)
    assert np.allclose(t.sum(axis=0), free) and (t >= 0).all() and t[2, 2] < t[1, 2] + 2
    assert np.allclose(C.split_targets(np.array([100.0, 300]), np.zeros(2)), np.outer([0.7, 0.1, 0.2], [100, 300]))


def test_placement_takes_the_nearest_split(spark):
    free = np.array([10.0, 10.0])
    one, rng = C.Placement(free, np.zeros(2)), random.Random(3)
    have = np.zeros((3, 2))
    aim = C.split_targets(free, np.zeros(2))
    cost = lambda h: (((h - aim) ** 2) / free).sum()
    for i in range(12):
        v = np.array([rng.randint(0, 2), rng.randint(0, 2)], float)
        where = C.SPLITS.index(one.place(f"g{i}", np.array([0, 1]), v))
        costs = [cost(have + np.outer(np.arange(3) == k, v)) for k in range(3)]
        assert costs[where] <= min(costs) + 1e-9
        have[where] += v


@pytest.mark.parametrize("blocks", [(1 << 15, 1 << 10), (7, 3)])
def test_dense_search_in_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(R, "BANK_ROWS", blocks[0])
    monkeypatch.setattr(R, "QUERY_ROWS", blocks[1])
    x = np.random.default_rng(4).integers(-2, 3, (40, 4)).astype(float)
    bank = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, vector array<double>, label int")
    q = bank.where("id % 5 = 0").select(F.col("id").alias("query_id"), "vector", "label")
    for parts in ((), ("label",)):
        got = {}
        for r in R.dense_top_k(q.drop(*{"label"} - set(parts)), bank, 3, parts).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.id
        for own in range(0, 40, 5):
            s = x @ x[own]
            order = [i for i in np.lexsort((np.arange(40), -s)).tolist() if i != own and (not parts or i % 2 == own % 2)]
            assert [got[own][k] for k in (1, 2, 3)] == order[:3]


def test_owner_of_a_key_with_many_labels(spark):
    df = spark.createDataFrame([("k", 1, 5, "a"), ("k", 2, 5, "b"), ("k", 3, 9, "c"), ("k", 4, 5, "d"), ("k", 5, 7, "e")], "h string, seq int, y int, id string")
    assert tuple(C.elect_owners(df, "h", "y", ["seq"]).first()) == ("k", None, 1, 4)


def test_panel_digest_sees_every_row(spark):
    df = spark.createDataFrame([("x", f"t{i}") for i in range(50)] + [("y", "t")], "lang string, text string")
    digest = lambda d: {r.lang: r.digest for r in C.panel_digest(d, "lang", "text").collect()}
    assert digest(df) == digest(df.orderBy(F.desc("text")))
    assert all(digest(df.where(F.col("text") != f"t{i}"))["x"] != digest(df)["x"] for i in (0, 3, 49))


def test_threshold_around_invalid_rows(spark):
    rows = [(0, 0.9, False), (0, 0.2, False), (0, 0.0, True), (1, 0.8, False), (1, 0.5, None)]
    df = spark.createDataFrame(rows, "label int, score double, invalid boolean")
    assert [M.threshold_with_invalid(df, b).first().threshold for b in (1 / 3, 2 / 3, 1.0)] == [math.nextafter(0.9, math.inf), 0.5, 0.2]
    assert M.threshold_with_invalid(df, 0.1).first().threshold is None


def test_high_thresholds_under_a_cap(spark):
    rows = [(0, s) for s in (0.1, 0.3, 0.3, 0.6, 0.7)] + [(1, 0.95)]
    got = {r.threshold: r.false_positives for r in M.high_thresholds(spark.createDataFrame(rows, "label int, score double"), 0.2, 0.4).collect()}
    assert got == {math.nextafter(s, math.inf): n for s, n in ((0.3, 2), (0.6, 1), (0.7, 0), (1.0, 0))}


def test_band_targets():
    assert S.band_targets({"a": 1, "b": 9, "c": 9}, 10) == {"a": 1, "b": 5, "c": 4}
    assert S.band_targets({"a": 5, "b": 5}, 3) == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        S.band_targets({"a": 1}, 2)


def test_held_out_filter_reasons(spark):
    far = lambda x: {"lo": x * 0x9E3779B97F4A7C15 % (1 << 62), "hi": x * 0xC2B2AE3D27D4EB4F % (1 << 62)}
    kind = "id int, hash string, strict string, fp struct<lo:long,hi:long>"
    held = spark.createDataFrame([(0, "h", "s", far(3))], kind).drop("id")
    rows = [(1, "h", "s", None), (2, "x", "s", None), (3, "y", "t", far(3)), (4, "z", "u", far(9)), (5, "w", "u", far(11)), (6, "v", "r", None)]
    got = {r.id: r.reason for r in C.held_out_filter(spark.createDataFrame(rows, kind), held).collect()}
    assert got == {1: "normalized_exact", 2: "strict_exact", 3: "near", 4: None, 5: "duplicate", 6: None}
