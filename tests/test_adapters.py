"""Adapters on rows of their upstream schemas."""

import pytest

from loomwright.operators import corpus as C
from loomwright.sources import adapters as A


def test_indexed(spark):
    df = A.indexed(spark.range(0, 100, 1, 7))
    assert all(r.id == r.row_index for r in df.collect())


def rows(spark, data, schema):
    return A.indexed(spark.createDataFrame(data, schema).coalesce(1))


def test_toxic_chat(spark):
    df = rows(spark, [("hi", 0, 0, "a"), ("hack", 1, 0, "b"), ("bad", 0, 1, "c")], "user_input string, jailbreaking int, toxicity int, conv_id string")
    got = {r.source_id: r for r in A.ADAPTERS["toxic_chat"].canonical(df, "train").collect()}
    assert [got[k].security_label for k in "abc"] == ["benign", "direct_jailbreak", "harmful_non_injection"]
    assert [got[k].source_role for k in "abc"] == ["auxiliary", "candidate", "candidate"]
    assert got["b"].security_tags == ["direct_jailbreak", "instruction_subversion"] and got["c"].routing_label == 1
    bad = rows(spark, [("hi", 2, 0, "a")], "user_input string, jailbreaking int, toxicity int, conv_id string")
    with pytest.raises(Exception, match="invalid binary labels"):
        A.ADAPTERS["toxic_chat"].canonical(bad, "train").collect()


def test_wild_sources(spark):
    data = [("vanilla_benign", "v", ""), ("vanilla_harmful", "v", ""), ("adversarial_benign", "v", "x"), ("adversarial_harmful", "v", "y"), ("adversarial_harmful", "v", " ")]
    got = A.ADAPTERS["wildjailbreak"].canonical(rows(spark, data, "data_type string, vanilla string, adversarial string"), "train").orderBy("group_id").collect()
    assert [r.label for r in got] == [0, 0, None, 1, None]
    assert [r.source_role for r in got] == ["candidate", "candidate", "auxiliary", "candidate", "uncertain"]
    assert len({r.split_group_id for r in got}) == 1 and got[4].text == "v"
    data = [("p", "harmful", False, "s"), ("p", "unharmful", False, "s"), ("q", "harmful", True, None), ("r", None, True, None)]
    got = A.ADAPTERS["wildguardmix"].canonical(rows(spark, data, "prompt string, prompt_harm_label string, adversarial boolean, subcategory string"), "test").orderBy("source_id").collect()
    assert [(r.label, r.source_role) for r in got] == [(0, "dev_test"), (0, "dev_test"), (None, "dev_test"), (None, "uncertain")]


def test_simple_sources(spark):
    cases = {
        "prompt_injections": ([("t", 1)], "text string, label int"),
        "xstest": ([("1", "p", "k", "safe")], "id string, prompt string, type string, label string"),
        "harmbench": ([("b", "1", " ctx ", "s")], "Behavior string, BehaviorID string, ContextString string, SemanticCategory string"),
        "do_not_answer": ([("1", "r", "q")], "id string, risk_area string, question string"),
        "notinject": ([("p", "k")], "prompt string, category string"),
        "jailbreaks_over_time": ([("p", 1, "u", "s"), (" ", 0, "v", "s")], "prompt string, label int, uid string, source string"),
        "gandalf": ([("t", 0.5)], "text string, similarity double"),
        "browsesafe": ([("t", "yes")], "content string, label string"),
        "banking77": ([("t", "k")], "text string, category string"),
        "false_reject": ([("t", 3, "k")], "prompt string, category int, category_text string"),
        "jbb_benign": ([("1", "g", "b", "k", "s")], "Index string, Goal string, Behavior string, Category string, Source string"),
    }
    for name, (data, schema) in cases.items():
        out = A.ADAPTERS[name].canonical(rows(spark, data, schema), "test").collect()
        assert len(out) == 1 and out[0].source == name and out[0].origins[0].source_role == out[0].source_role, name
        assert out[0].text == ("ctx\n\nb" if name == "harmbench" else out[0].text)
    with pytest.raises(ValueError, match="missing columns"):
        A.ADAPTERS["gandalf"].rows(rows(spark, [("t",)], "text string"), "test")


def test_shapes(spark):
    df = rows(spark, [("1", "r", "zh", "en")], "id string, risk_area string, zh_question string, en_question string")
    assert C.canonical(A.paired_translations(df)).select("text", "source_split").orderBy("text").collect() == [("en", "test_en"), ("zh", "test_zh")]
    df = spark.createDataFrame([("1", "A", "pre", "post")], "sample_id string, attack string, pre_prompt string, post_prompt string")
    got = {r.source_id: r for r in C.canonical(A.attack_and_context(df, "hijacking")).collect()}
    assert got["hijacking:1:context"].text == "pre\nA\npost" and got["hijacking:1:attack"].security_label == "direct_prompt_injection"
    attacks = rows(spark, [(f"a{i}",) for i in range(5)], "attack string")
    contexts = rows(spark, [("abcd",), ("wxyz",)], "context string")
    out = A.position_contexts(attacks, contexts).collect()
    assert len(out) == 15 and {r.text for r in out if r.attack == "a0"} == {"a0\nabcd", "ab\na0\ncd", "abcd\na0"}
    pairs = spark.createDataFrame([("p", 0, "s", "t", "x"), ("p", 1, "s", "t", "x"), ("q", 1, "s2", "t", "x"), ("r", 0, "s3", "a", "x"), ("r", 1, "s3", "b", "y")], "pair_id string, label int, scenario string, source_split string, kind string")
    assert {(r.key, r.rule) for r in A.pair_violations(pairs, ["kind"]).collect()} == {("q", "pair"), ("r", "pair"), ("s3", "scenario_split")}
    kept, held = A.quarantined(spark.createDataFrame([("a@b.org mail",), ("fine",)], "text string"))
    assert kept.count() == 1 and held.first().quarantine_reasons == ["email_address"]
    stress = A.position_stress(rows(spark, [(f"t{i}", f"g{i // 2}") for i in range(6)], "text string, group_id string")).collect()
    assert [(r["first"], r["second"]) for r in stress] == [("t0", "t5"), ("t4", "t1")]
