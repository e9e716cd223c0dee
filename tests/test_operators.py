"""Operators on small literal tables with known outcomes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions import numeric as N
from loomwright.operators import cascade as K
from loomwright.operators import corpus as C
from loomwright.operators import graph, ledger, sampling
from loomwright.operators import metrics as M


def panel(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "label int, score double")


def test_ranking_values(spark):
    r = M.ranking(panel(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])).first()
    assert r.auroc == pytest.approx(0.75) and r.average_precision == pytest.approx(5 / 6)
    c = M.confusion(panel(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]), threshold=0.4).first()
    assert (c.tp, c.fp) == (1, 1)


def test_ranking_equals_pairs(spark):
    r = random.Random(1)
    labels, scores = [r.randint(0, 1) for _ in range(120)], [r.randint(0, 9) / 10 for _ in range(120)]
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert M.ranking(panel(spark, labels, scores)).first().auroc == pytest.approx(want)


def test_thresholds(spark):
    df = panel(spark, [0, 0, 0, 1, 1], [0.1, 0.2, 0.9, 0.8, 0.95])
    assert M.threshold_at_fpr(df, 1 / 3).first().threshold == 0.8
    worst = panel(spark, [0, 0, 1, 1], [0.9, 0.8, 0.2, 0.1])
    t = M.threshold_at_fpr(worst, 0.0).first()
    assert t.above and t.threshold == math.nextafter(0.9, math.inf)


def test_wilson_and_exact_bounds(spark):
    low, high = N.wilson(F.lit(5), F.lit(10))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (r.a, r.b) == (pytest.approx(0.236593, abs=1e-6), pytest.approx(0.763407, abs=1e-6))
    assert N.clopper_pearson_upper(0, 59) == pytest.approx(1 - 0.05 ** (1 / 59))
    assert N.supported_budget(58, 0.05) is None and N.supported_budget(59, 0.05) == 0


def test_balanced_weights(spark):
    rows = [(1, "a", "g1"), (1, "a", "g1"), (1, "a", "g2"), (1, "b", "g3"), (0, "c", "g4")]
    df = spark.createDataFrame(rows, "label int, source string, group_id string")
    assert sorted(r.weight for r in C.balanced_weights(df).collect()) == [0.3125, 0.3125, 0.625, 1.25, 2.5]


def test_exact_merge(spark):
    rows = [("k", 1, 1, "toxic", ["x"]), ("k", 2, 1, "unknown", ["y"]), ("c", 3, 0, "unknown", ["x"]), ("c", 4, 1, "unknown", ["x"]), ("s", 5, 0, "unknown", ["z"])]
    df = spark.createDataFrame(rows, "h string, id int, routing_label int, toxicity string, security_tags array<string>")
    merged, out = C.merge_exact(df, "h", [F.col("id")])
    got = {r.h: r for r in merged.collect()}
    assert set(got) == {"k", "s"} and sorted(r.id for r in out.collect()) == [3, 4]
    assert got["k"].id == 1 and got["k"].security_tags == ["x", "y"] and got["k"].toxicity == "unknown"
    assert got["k"].annotation_disagreement_fields == ["toxicity"] and got["s"].annotation_disagreement_fields == []


def test_canonical_fails_closed(spark):
    row = [("t", 1, "s", "train", "1", "g", "benign")]
    df = spark.createDataFrame(row, "text string, label int, source string, source_split string, source_id string, group_id string, security_label string")
    with pytest.raises(Exception, match="label_against_security_label"):
        C.canonical(df).collect()
    assert C.canonical(df, fail=False).count() == 0


def test_banded_pairs_boundary(spark):
    bits = lambda n: sum(1 << (17 * i % 64) for i in range(n))
    rows = [("a", "ha", (0, 0)), ("b", "hb", (bits(6), 0)), ("c", "hc", (-1, bits(7))), ("d", "hd", (-1, 0)), ("e", "ha", (0, 0)), ("f", "hf", None)]
    df = spark.createDataFrame(rows, "id string, hash string, fp struct<lo:long,hi:long>")
    got = {(r.left_id, r.right_id): r.distance for r in C.banded_pairs(df, df).collect() if r.left_id < r.right_id}
    assert got == {("a", "b"): 6, ("b", "e"): 6}


def test_split_exactness(spark):
    rows = [(f"{s}{y}{i}", s, y) for s in "ab" for y in (0, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "split_group_id string, source string, routing_label int")
    placed = df.join(C.stratified_split(df), "split_group_id").groupBy("source", "routing_label", "split").count().collect()
    assert {r["split"]: r["count"] for r in placed if (r.source, r.routing_label) == ("a", 1)} == {"train": 70, "validation": 10, "dev_test": 20}


def test_leakage_views(spark):
    rows = [("1", "dev_test", "x"), ("2", "train", "x"), ("3", "train", "y"), ("4", "validation", "y"), ("5", "validation", "x"), ("6", "validation", "z"), ("7", "train", "w")]
    df = spark.createDataFrame(rows, "id string, split string, strict_hash string")
    near = spark.createDataFrame([("7", "1", 3), ("6", "7", 2)], "left_id string, right_id string, distance int")
    got = {r.id: r.reason for r in C.leakage_views(df, near).collect()}
    assert got == {"1": None, "2": "strict_dev_test_overlap", "3": None, "4": "strict_train_overlap", "5": "strict_dev_test_overlap", "6": None, "7": "near_dev_test_overlap"}


def test_owner_election_closed_form(spark):
    r = random.Random(5)
    rows = [(f"k{i // 5}", i, r.randint(0, 1), str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "h string, seq int, y int, id string")
    got = {x.h: x for x in C.elect_owners(df, "h", "y", ["seq"]).collect()}
    for k in got:
        ys = [y for h, _, y, _ in rows if h == k]
        p = next((i + 1 for i, y in enumerate(ys) if y != ys[0]), None)
        assert (got[k].owner_id is None) == (p is not None)
        assert (got[k].strict_duplicate, got[k].strict_label_conflict) == ((len(ys) - 1, 0) if p is None else (p - 2, len(ys) - p + 2))


def test_components_random(spark):
    r = random.Random(8)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e}


def test_cascade_replay(spark):
    rows = [
        ("high", [0.1, 0.9999], "direct_user", 0.9, [0.1, 0.1]),
        ("single", [0.5], "direct_user", None, [0.1]),
        ("low", [0.1], "direct_user", 0.9, [0.9]),
        ("untrusted", [0.5, 0.01], "untrusted_content", 0.2, [0.3, 0.9]),
        ("batches", [0.5] * 6, "direct_user", 0.9, [0.1, 0.9, 0.1, None, 0.9, 0.9]),
    ]
    df = spark.createDataFrame(rows, "id string, scores array<double>, channel string, artifact_p double, window_p array<double>")
    got = {r.id: (r.flag, r.artifact_calls, r.window_calls, r.invalid_reviews) for r in K.replay(df, 0.2, 0.1, 0.99, 0.5).collect()}
    assert got == {"high": (True, 0, 0, 0), "single": (True, 1, 0, 1), "low": (False, 0, 0, 0), "untrusted": (False, 1, 1, 0), "batches": (True, 0, 4, 1)}


def test_route_rejects_bad_input(spark):
    df = spark.createDataFrame([(1.5, "direct_user")], "s double, c string")
    none, no = F.lit(None).cast("double"), F.lit(False)
    with pytest.raises(Exception, match="finite probability"):
        df.select(K.route(F.col("s"), F.col("c"), none, no)).collect()
    with pytest.raises(Exception, match="unknown channel"):
        df.select(K.route(F.lit(0.5), F.lit("mail"), none, no)).collect()


def test_sampling_and_ledger(spark):
    assert sampling.equal_quotas({"a": 1, "b": 10, "c": 10}, 11) == {"a": 1, "b": 5, "c": 5}
    df = spark.createDataFrame([(0,), (1,), (4,), (70_000,)], "r long")
    got = {(x.first_missing, x.last_missing) for x in ledger.missing_ranges(df, [], "r").collect()}
    assert got == {(2, 3), (5, 69_999)}
    placed = sampling.seeded_order(spark.range(500), "id", "s").collect()
    assert sorted(x.place for x in placed) == list(range(500))
