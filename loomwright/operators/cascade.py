"""Three-zone routing, cascade replay, policy decisions, label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.numeric import ratio

# The zones of the routing contract.
LOW = {"direct_user": 0.2, "untrusted_content": 0.025}
HIGH, FLAG, BATCH, MOST_WINDOWS = 0.9999, 0.5, 4, 128


def low_of(channel: Column) -> Column:
    out = F.raise_error(F.concat(F.lit("unknown channel "), F.coalesce(channel, F.lit("(null)")))).cast("double")
    for name, low in LOW.items():
        out = F.when(channel == name, F.lit(low)).otherwise(out)
    return out


def route(score: Column, channel: Column, probability: Column, failed: Column) -> Column:
    """struct<route, reason>; a reviewer's verdict outside the middle zone, or
    together with a failure, raises, as does a score that is no probability."""
    low = low_of(channel)
    bad = (
        F.when(score.isNull() | F.isnan(score) | ~score.between(0, 1), "score must be a finite probability")
        .when(failed & probability.isNotNull(), "verdict and failure are mutually exclusive")
        .when(F.isnan(probability) | ~probability.between(0, 1), "verdict must be a finite probability")
        .when((probability.isNotNull() | failed) & ~((score >= low) & (score < HIGH)), "verdict is only valid in the middle zone")
    )
    of = lambda r, why: F.struct(F.lit(r).alias("route"), F.lit(why).alias("reason"))
    chain = (
        F.when(score < low, of("pass", "local_low"))
        .when(score >= HIGH, of("restrict", "local_high"))
        .when(failed, of("restrict", "reviewer_failed"))
        .when(probability < FLAG, of("pass", "reviewer_clear"))
        .when(probability >= FLAG, of("restrict", "reviewer_flag"))
        .otherwise(of("review", "review_required"))
    )
    return F.when(bad.isNotNull(), F.raise_error(bad).cast("struct<route:string,reason:string>")).otherwise(chain)


def document_route(scores: Column, channel: Column) -> Column:
    """From window scores alone: any high restricts; all low passes, unless an
    untrusted document has several windows."""
    low = low_of(channel)
    several = (channel == "untrusted_content") & (F.size(scores) > 1)
    return (
        F.when(F.size(scores) > MOST_WINDOWS, "restrict")
        .when(F.exists(scores, lambda s: s >= HIGH), "restrict")
        .when(F.forall(scores, lambda s: s < low) & ~several, "pass")
        .otherwise("review")
    )


def replay(df: DataFrame, direct_low: float, untrusted_low: float, high: float, reviewer: float) -> DataFrame:
    """Exact replay of the ordered cascade over ``scores`` (array), ``channel``,
    ``artifact_p`` and ``window_p`` (array; null: failed review): adds flag,
    artifact_calls, window_calls, invalid_reviews.

    A failed or flagging review restricts. Pending windows go in batches of
    four; a whole batch counts as called even if its first window restricts."""
    s, low = F.col("scores"), F.when(F.col("channel") == "direct_user", direct_low).otherwise(untrusted_low)
    bad = lambda p: p.isNull() | (p >= reviewer)
    any_high, single = F.exists(s, lambda x: x >= high), F.size(s) == 1
    untrusted = F.col("channel") == "untrusted_content"
    artifact = ~any_high & F.when(single, s[0] >= low).otherwise(untrusted)
    artifact_bad = artifact & bad(F.col("artifact_p"))
    pending = F.filter(F.transform(F.arrays_zip(s.alias("s"), F.col("window_p").alias("p")), lambda z: z), lambda z: z["s"] >= low)
    go = ~any_high & ~single & ~artifact_bad
    first_bad = F.coalesce(F.array_min(F.filter(F.transform(pending, lambda z, i: F.when(bad(z["p"]), i)), lambda i: i.isNotNull())), F.lit(-1))
    called = F.when(~go, 0).when(first_bad < 0, F.size(pending)).otherwise(F.least(F.size(pending), (F.floor(first_bad / BATCH) + 1).cast("int") * BATCH))
    failed = lambda n: F.size(F.filter(F.slice(pending, F.lit(1), n), lambda z: z["p"].isNull()))
    return df.withColumns(
        {
            "flag": any_high | artifact_bad | (go & (first_bad >= 0)),
            "artifact_calls": artifact.cast("long"),
            "window_calls": called.cast("long"),
            "invalid_reviews": ((artifact & F.col("artifact_p").isNull()).cast("long") + F.when(called > 0, failed(F.greatest(called, F.lit(1)))).otherwise(0)).cast("long"),
        }
    )


def economics(df: DataFrame, by: list[str], call_cost: float) -> DataFrame:
    """Cleared, flagged, missed and cost of a replayed cascade."""
    y = F.col("label")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("flag") & (y == 1)).alias("caught"),
        F.count_if(~F.col("flag") & (y == 1)).alias("missed"),
        F.count_if(F.col("flag") & (y == 0)).alias("false_alarms"),
        F.sum(F.col("artifact_calls") + F.col("window_calls")).alias("calls"),
        (F.sum(F.col("artifact_calls") + F.col("window_calls")).cast("decimal(20,0)") * F.lit(call_cost).cast("decimal(18,6)")).cast("double").alias("cost"),
        ratio(F.count_if((F.col("artifact_calls") + F.col("window_calls")) > 0), F.count("*")).alias("call_rate"),
    )


# Provenance channels by trust.
TRUSTED, UNTRUSTED = ("system", "developer", "user"), ("tool", "web", "email", "document")


def provenance_trust(sources: Column) -> Column:
    """The lowest trust present; null where a channel is unknown."""
    known = F.forall(sources, lambda s: s.isin(*TRUSTED, *UNTRUSTED))
    return F.when(known, F.when(F.exists(sources, lambda s: s.isin(*UNTRUSTED)), "untrusted").otherwise("trusted"))


def authorize(tool: Column, arguments: Column, provenance: Column, sensitive: Column, argument_sources: Column, capability: Column) -> Column:
    """struct<allowed, reason> by the first rule that fails. ``capability`` is
    null for a tool that is not granted, else a struct of constrained
    (map<string, array<string>>), free (array), allow_sensitive, trusted_only
    and allowed_sources (map<string, array<string>>)."""
    c = capability
    trust = provenance_trust(provenance)
    names = F.array_union(F.map_keys(c["constrained"]), c["free"])
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    first = lambda keys, fails: F.try_element_at(F.filter(keys, fails), F.lit(1))  # in the policy's order
    wrong = first(F.map_keys(c["constrained"]), lambda k: ~F.coalesce(F.array_contains(c["constrained"][k], arguments[k]), F.lit(False)))
    sources = F.coalesce(argument_sources, F.create_map().cast("map<string,array<string>>"))
    stray = first(F.map_keys(c["allowed_sources"]), lambda k: F.size(F.array_except(sources[k], c["allowed_sources"][k])) > 0)
    reason = F.coalesce(
        F.when(tool.isNull() | arguments.isNull(), F.lit("invalid_action_schema")),
        F.when(sensitive.isNull() | provenance.isNull() | (F.size(provenance) == 0) | F.exists(provenance, lambda s: F.coalesce(F.trim(s), F.lit("")) == ""), F.lit("invalid_context_schema")),
        F.when(c.isNull(), F.lit("tool_not_granted")),
        F.when(F.size(F.array_intersect(F.map_keys(c["constrained"]), c["free"])) > 0, F.lit("invalid_policy")),
        F.when(trust.isNull(), F.lit("unknown_provenance")),
        F.when((trust == "untrusted") & c["trusted_only"], F.lit("untrusted_origin_for_capability")),
        F.when((trust == "untrusted") & sensitive, F.lit("sensitive_data_from_untrusted_origin")),
        F.when(~same(F.map_keys(arguments), names), F.lit("argument_schema_mismatch")),
        F.when(F.exists(F.map_values(arguments), lambda v: v.isNull()), F.lit("invalid_argument_type")),
        F.when(wrong.isNotNull(), F.concat(F.lit("argument_not_granted:"), wrong)),
        F.when(~same(F.map_keys(sources), F.map_keys(c["allowed_sources"])), F.lit("argument_source_schema_mismatch")),
        F.when(stray.isNotNull(), F.concat(F.lit("argument_source_not_granted:"), stray)),
        F.when(sensitive & ~c["allow_sensitive"], F.lit("sensitive_data_not_granted")),
        F.lit("allowed"),
    )
    return F.struct((reason == "allowed").alias("allowed"), reason.alias("reason"))


def derived(parts: Column) -> Column:
    """Labels of a derived value: the union of those of its parts
    (array<struct<sources, provenance, sensitive>>)."""
    union = lambda f: F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: p[f]))))
    return F.struct(union("sources").alias("sources"), union("provenance").alias("provenance"), F.exists(parts, lambda p: p["sensitive"]).alias("sensitive"))
