"""Source adapters: from an upstream table to the rows that ``canonical`` takes.

An adapter is a projection of one upstream schema: text, label, lineage, role
and annotations as columns. It takes the upstream rows with a ``row_index``
(:func:`indexed`) and the name of their split, checks the columns it needs and
rejects values outside the upstream's own domain. Source-specific extras go
into one map, ``source_fields``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomwright.functions import text as X
from loomwright.operators import corpus as C
from loomwright.sources.readers import require_columns

c, lit = F.col, F.lit


def indexed(df: DataFrame, order: str = "row_index") -> DataFrame:
    """Gapless row numbers from 0 in scan order: counts per partition, then an
    offset for each; rows are not moved."""
    parts = df.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = W.Window.orderBy("__p").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select("__p", "__first", F.coalesce(F.sum("__n").over(before), lit(0)).alias("__s"))
    return parts.join(F.broadcast(starts), "__p").withColumn(order, c("__m") - c("__first") + c("__s")).drop("__p", "__m", "__first", "__s")


def expect(ok: Column, message: str, value: Column) -> Column:
    """``value`` where ``ok`` holds, else an error."""
    return F.when(F.coalesce(ok, lit(False)), value).otherwise(F.raise_error(lit(message)).cast("string"))


def fields(**extras: Column) -> Column:
    """Extras as map<string,string>; null ones are left out."""
    m = F.create_map(*(x for k, v in sorted(extras.items()) for x in (lit(k), v.cast("string")))) if extras else F.create_map().cast("map<string,string>")
    return F.map_filter(m, lambda _, v: v.isNotNull())


def blank(col: Column) -> Column:
    return F.coalesce(F.trim(col), lit("")) == ""


def by_split(split: str, train: str = "train") -> Column:
    return lit("candidate" if split == train else "dev_test")


@dataclass(frozen=True)
class Adapter:
    """A source's name, the columns it needs and its projection per split."""

    name: str
    required: Sequence[str]
    project: Callable[[DataFrame, str], dict[str, Column]]
    keep: Callable[[str], Column] | None = None

    def rows(self, df: DataFrame, split: str) -> DataFrame:
        require_columns(df, [*self.required, "row_index"])
        if self.keep is not None:
            df = df.where(self.keep(split))
        cols = {"source": lit(self.name), "source_split": lit(split), "label": lit(None).cast("int"), "source_fields": fields()} | self.project(df, split)
        return df.select(*(v.alias(k) for k, v in cols.items()))

    def canonical(self, df: DataFrame, split: str) -> DataFrame:
        """Canonical rows with roles; where the adapter sets none, the core rule does."""
        out = C.canonical(self.rows(df, split))
        role = c("role") if "role" in out.columns else C.core_role(c("source"), c("label"), c("toxicity"), c("source_split"))
        return C.with_role(out, role).drop("role")


def tagged(name: str, *parts: Column) -> Column:
    return F.concat_ws(":", lit(name), *parts)


def numbered(split: str, text: Column) -> Column:
    return F.concat_ws(":", lit(split), c("row_index"), X.text_hash(text))


def toxic_chat(df: DataFrame, split: str) -> dict[str, Column]:
    attack, toxic = c("jailbreaking") == 1, c("toxicity") == 1
    fine = c("jailbreaking").isin(0, 1) & c("toxicity").isin(0, 1)
    return {
        "text": expect(fine, "toxic_chat has invalid binary labels", c("user_input")),
        "label": c("jailbreaking").cast("int"),
        "attack_type": F.when(attack, "direct_jailbreak"),
        "source_id": c("conv_id"),
        "group_id": tagged("toxic_chat", c("conv_id")),
        "category": F.when(toxic, "toxic").otherwise("not_toxic"),
        "goal_policy_status": F.when(toxic, "unsafe").otherwise("unknown"),
        "toxicity": F.when(toxic, "toxic").otherwise("not_toxic"),
        "label_basis": lit("official_jailbreak_and_toxicity_annotations"),
    }


def prompt_injections(df: DataFrame, split: str) -> dict[str, Column]:
    h = X.text_hash(c("text"))
    return {"text": c("text"), "label": c("label").cast("int"), "attack_type": F.when(c("label") == 1, "direct_prompt_injection"), "source_id": h, "group_id": tagged("prompt_injections", h)}


def nonattack(name: str, text: Column, key: Column, category: Column, status: Column, basis: str, **more: Column) -> dict[str, Column]:
    return {"text": text, "label": lit(0), "source_id": key, "group_id": tagged(name, key), "category": category, "goal_policy_status": status, "label_basis": lit(basis), **more}


def harmbench(df: DataFrame, split: str) -> dict[str, Column]:
    context = F.trim("ContextString")
    text = F.when(blank(c("ContextString")), c("Behavior")).otherwise(F.concat(context, lit("\n\n"), c("Behavior")))
    return nonattack("harmbench", text, c("BehaviorID"), c("SemanticCategory"), lit("unsafe"), "task_definition:harmful_goal_not_injection")


def gandalf(df: DataFrame, split: str) -> dict[str, Column]:
    return {
        "text": c("text"),
        "label": lit(1),
        "attack_type": lit("direct_prompt_injection"),
        "source_id": numbered(split, c("text")),
        "group_id": tagged("gandalf", X.text_hash(c("text"))),
        "label_basis": lit("filtered_human_attack_attempt"),
        "source_fields": fields(source_similarity=c("similarity").cast("double")),
        "role": by_split(split),
    }


def browsesafe(df: DataFrame, split: str) -> dict[str, Column]:
    yes = c("label") == "yes"
    return {
        "text": expect(c("label").isin("yes", "no"), "browsesafe has an unexpected label", c("content")),
        "label": yes.cast("int"),
        "attack_type": F.when(yes, "indirect_prompt_injection"),
        "source_id": numbered(split, c("content")),
        "group_id": tagged("browsesafe", lit(split), X.text_hash(c("content"))),
        "input_channel": lit("untrusted_content"),
        "label_basis": lit("benchmark_document_construction"),
        "source_fields": fields(document_characters=F.length("content"), document_granularity=lit("whole_document"), known_attack_span=lit(False)),
        "role": by_split(split),
    }


def wildjailbreak(df: DataFrame, split: str) -> dict[str, Column]:
    kind = c("data_type")
    vanilla = c("vanilla") if "vanilla" in df.columns else lit(None).cast("string")
    hostile = kind.startswith("adversarial_")
    text = F.when(hostile, c("adversarial")).otherwise(vanilla)
    lost = hostile & blank(c("adversarial"))
    known = kind.isin("vanilla_benign", "vanilla_harmful", "adversarial_benign", "adversarial_harmful")
    agrees = (c("label") == F.when(kind == "adversarial_harmful", "1").otherwise("0")) if split == "eval" else lit(True)
    attack = (kind == "adversarial_harmful") & ~lost
    base = F.coalesce(F.when(~blank(vanilla), vanilla), text)
    return {
        "text": expect(known & agrees, "wildjailbreak has an unexpected data_type or label", F.when(lost, vanilla).otherwise(text)),
        "label": F.when(lost | (kind == "adversarial_benign"), lit(None).cast("int")).otherwise(attack.cast("int")),
        "attack_type": F.when(attack, "direct_jailbreak"),
        "security_label": F.when(lost | (kind == "adversarial_benign"), "uncertain").when(kind == "vanilla_benign", "benign").when(kind == "vanilla_harmful", "harmful_non_injection").otherwise("direct_jailbreak"),
        "source_id": numbered(split, F.when(lost, vanilla).otherwise(text)),
        "group_id": tagged("wildjailbreak", lit(split), c("row_index")),
        "split_group_id": tagged("wildjailbreak", lit("base"), X.text_hash(base)),
        "category": F.when(lost, F.concat(kind, lit(":missing_adversarial_text"))).otherwise(kind),
        "goal_policy_status": F.when(lost | kind.endswith("_benign"), "safe").otherwise("unsafe"),
        "label_basis": F.when(lost, "source_row_missing_adversarial_projection").otherwise("four_way_source_construction"),
        "role": F.when(lost, "uncertain").when(kind == "adversarial_benign", "auxiliary").otherwise(by_split(split)),
    }


def wildguardmix(df: DataFrame, split: str) -> dict[str, Column]:
    harm, hostile = c("prompt_harm_label"), c("adversarial")
    fine = (harm.isNull() | harm.isin("harmful", "unharmful")) & hostile.isNotNull()
    clear = harm.isNotNull() & ~hostile
    eligible = (harm == "harmful") | ((harm == "unharmful") & ~hostile)
    return {
        "text": expect(fine, "wildguardmix has an unexpected prompt label", c("prompt")),
        "label": F.when(clear, 0),
        "security_label": F.when(clear & (harm == "harmful"), "harmful_non_injection").when(clear, "benign").otherwise("uncertain"),
        "source_id": numbered(split, c("prompt")),
        "group_id": tagged("wildguardmix", lit(split), X.text_hash(c("prompt"))),
        "category": c("subcategory"),
        "goal_policy_status": F.when(harm == "harmful", "unsafe").when(harm == "unharmful", "safe").otherwise("unknown"),
        "label_basis": lit("source_model_weak_prompt_harmfulness" if split == "train" else "three_human_annotators_prompt_harmfulness"),
        "source_fields": fields(source_adversarial=hostile, source_harmfulness_label=harm),
        "role": F.when(lit(split == "test") & F.coalesce(eligible, lit(False)), "dev_test").when(harm.isNotNull(), "auxiliary").otherwise("uncertain"),
    }


def false_reject(df: DataFrame, split: str) -> dict[str, Column]:
    basis = "human_validated_benign_overrefusal_test" if split == "test" else "multi_agent_generated_benign_weak_label"
    return {
        "text": expect(~blank(c("category_text")) & c("category").isNotNull(), "false_reject has an invalid category", c("prompt")),
        "label": lit(0),
        "source_id": numbered(split, c("prompt")),
        "group_id": tagged("false_reject", lit(split), X.text_hash(c("prompt"))),
        "category": c("category_text"),
        "goal_policy_status": lit("safe"),
        "label_basis": lit(basis),
        "source_fields": fields(source_category_id=c("category"), source_language=lit("en")),
        "role": by_split(split),
    }


def banking77(df: DataFrame, split: str) -> dict[str, Column]:
    key = F.concat_ws(":", lit(split), c("row_index"))
    return nonattack(
        "banking77", expect(~blank(c("category")), "banking77 has no intent", c("text")), key, c("category"), lit("unknown"), "banking_assistant_intent_collection",
        source_fields=fields(source_intent=c("category"), source_language=lit("en")), role=by_split(split),
    )


ADAPTERS = {
    a.name: a
    for a in (
        Adapter("toxic_chat", ["user_input", "jailbreaking", "toxicity", "conv_id"], toxic_chat),
        Adapter("prompt_injections", ["text", "label"], prompt_injections),
        Adapter("xstest", ["id", "prompt", "type", "label"], lambda df, s: nonattack("xstest", c("prompt"), c("id"), c("type"), c("label"), "benchmark_nonattack")),
        Adapter("harmbench", ["Behavior", "BehaviorID", "ContextString", "SemanticCategory"], harmbench),
        Adapter("do_not_answer", ["id", "risk_area", "question"], lambda df, s: nonattack("do_not_answer", c("question"), c("id"), c("risk_area"), lit("unsafe"), "task_definition:harmful_goal_not_injection")),
        Adapter("notinject", ["prompt", "category"], lambda df, s: nonattack("notinject", c("prompt"), F.concat_ws(":", lit(s), c("row_index")), c("category"), lit("safe"), "benchmark_nonattack:injection_trigger_words")),
        Adapter(
            "jailbreaks_over_time", ["prompt", "label", "uid", "source"],
            lambda df, s: {"text": c("prompt"), "label": c("label").cast("int"), "attack_type": F.when(c("label") == 1, "direct_jailbreak"), "source_id": c("uid"), "group_id": tagged("jailbreaks_over_time", c("uid")), "category": df["source"], "label_basis": lit("source_temporal_annotation")},
            keep=lambda s: ~blank(c("prompt")),
        ),
        Adapter("gandalf", ["text", "similarity"], gandalf),
        Adapter("browsesafe", ["content", "label"], browsesafe),
        Adapter("wildjailbreak", ["data_type", "adversarial"], wildjailbreak),
        Adapter("wildguardmix", ["prompt", "prompt_harm_label", "adversarial", "subcategory"], wildguardmix),
        Adapter("banking77", ["text", "category"], banking77),
        Adapter("false_reject", ["prompt", "category", "category_text"], false_reject),
        Adapter("jbb_benign", ["Index", "Goal", "Behavior", "Category", "Source"], lambda df, s: nonattack("jbb_benign", c("Goal"), c("Index"), c("Category"), lit("safe"), "curated_thematically_matched_benign_behavior", source_id=tagged("benign", c("Index")), role=lit("dev_test"), source_fields=fields(source_behavior=c("Behavior"), source_behavior_source=c("Source")))),
    )
}


def paired_translations(df: DataFrame) -> DataFrame:
    """Two language columns of a harmful question as rows of one lineage."""
    require_columns(df, ["id", "risk_area", "zh_question", "en_question", "row_index"])
    sides = F.explode(F.array(*(F.struct(lit(k).alias("lang"), c(f"{k}_question").alias("text")) for k in ("zh", "en")))).alias("side")
    pair = F.concat_ws(":", "id", "row_index")
    group = tagged("do_not_answer", lit("paired"), pair)
    rows = df.select("risk_area", pair.alias("pair"), group.alias("group_id"), sides)
    return rows.select(
        c("side.text").alias("text"), lit(0).alias("label"), lit("do_not_answer").alias("source"), F.concat(lit("test_"), c("side.lang")).alias("source_split"),
        F.concat_ws(":", "pair", "side.lang").alias("source_id"), "group_id", c("risk_area").alias("category"), lit("unsafe").alias("goal_policy_status"),
        lit("task_definition:paired_harmful_goal_not_injection").alias("label_basis"), fields(source_language=c("side.lang")).alias("source_fields"),
    )


def attack_and_context(df: DataFrame, benchmark: str) -> DataFrame:
    """One benchmark row as the attack alone and as the context that carries it."""
    require_columns(df, ["sample_id", "attack", "pre_prompt", "post_prompt"])
    lineage = F.concat_ws(":", lit(benchmark), "sample_id")
    whole = F.concat_ws("\n", "pre_prompt", "attack", "post_prompt")
    side = lambda name, text, channel, security: F.struct(lit(name).alias("name"), text.alias("text"), lit(channel).alias("channel"), lit(security).cast("string").alias("security"))
    both = F.explode(F.array(side("attack", c("attack"), "direct_user", None), side("context", whole, "untrusted_content", "indirect_prompt_injection"))).alias("s")
    rows = df.select(lineage.alias("lineage"), both)
    return rows.select(
        c("s.text").alias("text"), lit(1).alias("label"), lit(f"prompt_{benchmark}").alias("attack_type"), lit("tensor_trust").alias("source"),
        F.concat(lit(benchmark + "_"), c("s.name"), lit("_test")).alias("source_split"), F.concat_ws(":", "lineage", "s.name").alias("source_id"),
        tagged("tensor_trust", c("lineage")).alias("group_id"), lit(benchmark).alias("category"), c("s.channel").alias("input_channel"),
        c("s.security").alias("security_label"), lit("benchmark_human_attack").alias("label_basis"),
    )


def position_contexts(attacks: DataFrame, contexts: DataFrame) -> DataFrame:
    """Attack i in context i mod n at each of three positions: an equi-join."""
    n = contexts.count()
    at = attacks.withColumn("k", c("row_index") % n).join(contexts.select(c("row_index").alias("k"), "context"), "k")
    spots = at.select("attack", "context", "row_index", F.explode(F.array(*map(lit, ("start", "middle", "end")))).alias("position"))
    return spots.withColumn("text", X.insert_at(c("context"), c("attack"), c("position")))


def position_stress(rows: DataFrame, most: int = 500) -> DataFrame:
    """Even rows with reversed odd rows of other groups, the first ``most``."""
    n = rows.count() // 2
    even = rows.where("row_index % 2 = 0").select((c("row_index") / 2).cast("long").alias("k"), c("text").alias("first"), c("group_id").alias("g1"))
    odd = rows.where("row_index % 2 = 1").select((lit(n - 1) - (c("row_index") - 1) / 2).cast("long").alias("k"), c("text").alias("second"), c("group_id").alias("g2"))
    return even.join(odd, "k").where("g1 <> g2").orderBy("k").limit(most)


def pair_violations(rows: DataFrame, equal: Sequence[str]) -> DataFrame:
    """Pairs that are not one row of each label with equal fields, and
    scenarios that more than one split holds."""
    g = rows.groupBy("pair_id").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("label")).alias("labels"), F.greatest(lit(1), *(F.count_distinct(F.coalesce(c(e).cast("string"), lit("\0"))) for e in equal)).alias("variants")
    )
    bad = g.where((c("n") != 2) | (c("labels") != F.array(lit(0), lit(1))) | (c("variants") > 1)).select(c("pair_id").alias("key"), lit("pair").alias("rule"))
    s = rows.groupBy("scenario").agg(F.count_distinct("source_split").alias("n")).where("n > 1")
    return bad.unionByName(s.select(c("scenario").alias("key"), lit("scenario_split").alias("rule")))


def quarantined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, held back with sorted reasons) by sensitive text."""
    marked = rows.withColumn("quarantine_reasons", X.sensitive_reasons(c("text")))
    return marked.where(F.size("quarantine_reasons") == 0).drop("quarantine_reasons"), marked.where(F.size("quarantine_reasons") > 0)
