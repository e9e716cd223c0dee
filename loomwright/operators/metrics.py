"""Evaluation algebra over score tables: confusion, ranking, slices, curves.

Every function takes a DataFrame with ``label`` (0/1) and ``score`` and an
optional list of grouping columns. Curves group equal scores first, so each
distinct score is one row; sums over them run within ranges of scores, to which
the totals of the ranges above are added, so no panel is one task's to rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomwright.functions.numeric import Z95, next_after, ratio, wilson


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def confusion(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    flag = F.col("score") >= threshold
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        count_if((F.col("label") == 1) & flag).alias("tp"),
        count_if((F.col("label") == 0) & flag).alias("fp"),
        count_if((F.col("label") == 0) & ~flag).alias("tn"),
        count_if((F.col("label") == 1) & ~flag).alias("fn"),
        F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"),
    )


def binary_metrics(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5, z: float = Z95) -> DataFrame:
    """Confusion with recall, fpr, precision, accuracy and Wilson bounds; a rate
    without trials is null."""
    c = confusion(df, by, threshold)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    low, high = wilson(tp, tp + fn, z)
    flow, fhigh = wilson(fp, fp + tn, z)
    return c.withColumns(
        {
            "recall": ratio(tp, tp + fn),
            "fpr": ratio(fp, fp + tn),
            "precision": ratio(tp, tp + fp),
            "accuracy": ratio(tp + tn, F.col("n")),
            "recall_low": low,
            "recall_high": high,
            "fpr_low": flow,
            "fpr_high": fhigh,
            "fp_per_10k": 10_000 * ratio(fp, fp + tn),
        }
    )


#: Ranges of scores in a unit, and the scores beyond which one range holds all.
RANGES, FARTHEST = 1024, 64.0


def score_range(score: Column) -> Column:
    """The range of a score; ranges ascend with scores, NaN above all."""
    near = F.floor(F.least(F.greatest(score, F.lit(-FARTHEST)), F.lit(FARTHEST)) * RANGES)
    return F.when(F.isnan(score), F.lit(int(FARTHEST) * RANGES + 1)).otherwise(near).cast("int")


def running(df: DataFrame, by: Sequence[str], column: str, sums: dict[str, str], descending: bool = True) -> DataFrame:
    """``df`` with running sums, named by ``sums``' keys, of its values' columns
    along ``column``: within ranges, plus the totals of all ranges before."""
    turn = F.desc if descending else F.asc
    rows = df.withColumn("__range", score_range(F.col(column).cast("double")))
    totals = rows.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = W.Window.partitionBy(*by).orderBy(turn("__range")).rowsBetween(W.Window.unboundedPreceding, -1)
    starts = totals.select(*by, "__range", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    inner = W.Window.partitionBy(*by, "__range").orderBy(turn(column)).rowsBetween(W.Window.unboundedPreceding, 0)
    joined = rows.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()}).join(starts, [*by, "__range"])
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *(f"__{n}" for n in sums))


def curve(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, with what ``score >= threshold`` flags:
    threshold, tp, fp, positives, negatives, recall, fpr, precision."""
    ties = df.groupBy(*by, "score").agg(count_if(F.col("label") == 1).alias("p"), count_if(F.col("label") == 0).alias("q"))
    totals = df.groupBy(*by).agg(count_if(F.col("label") == 1).alias("positives"), count_if(F.col("label") == 0).alias("negatives"))
    out = running(ties, by, "score", {"tp": "p", "fp": "q"})
    out = out.join(F.broadcast(totals), list(by)) if by else out.crossJoin(F.broadcast(totals))
    return out.select(
        *by,
        F.col("score").alias("threshold"),
        "p",
        "q",
        "tp",
        "fp",
        "positives",
        "negatives",
        ratio(F.col("tp"), F.col("positives")).alias("recall"),
        ratio(F.col("fp"), F.col("negatives")).alias("fpr"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def ranking(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUROC (ties count half) and average precision (one step per score)."""
    c = curve(df, by)
    area = F.sum(F.col("p") * (F.col("negatives") - F.col("fp") + F.col("q") / 2))
    return c.groupBy(*by).agg(
        (area / F.nullif(F.max("positives") * F.max("negatives"), F.lit(0))).alias("auroc"),
        (F.sum(F.col("p") * F.col("precision")) / F.nullif(F.max("positives"), F.lit(0))).alias("average_precision"),
    )


def threshold_at_fpr(df: DataFrame, budget: float, by: Sequence[str] = ()) -> DataFrame:
    """The lowest threshold among all scores whose FPR keeps the budget; the
    next number beyond the largest score (``above`` true) if none does."""
    c = curve(df, by)
    fine = F.col("fp") <= budget * F.col("negatives")
    best = c.groupBy(*by).agg(F.min(F.when(fine, F.col("threshold"))).alias("kept"), F.max("threshold").alias("top"))
    beyond = next_after(F.when(F.col("kept").isNull(), F.col("top")))  # nulls elsewhere
    return best.select(*by, F.coalesce("kept", beyond).alias("threshold"), F.col("kept").isNull().alias("above"))


def threshold_with_invalid(df: DataFrame, budget: float, by: Sequence[str] = ()) -> DataFrame:
    """As :func:`threshold_at_fpr` for rows of which some (``invalid``) have no
    usable score and are flagged whatever the threshold; null where not even a
    threshold beyond all scores keeps the budget."""
    invalid = F.coalesce(F.col("invalid"), F.lit(False))
    always = df.groupBy(*by).agg(count_if(invalid & (F.col("label") == 0)).alias("always"), count_if(F.col("label") == 0).alias("all_negatives"))
    kept = curve(df.where(~invalid), by).select(*by, "threshold", "fp")
    kept = always.join(kept, list(by), "left") if by else always.crossJoin(kept)
    fine = F.col("always") + F.col("fp") <= budget * F.col("all_negatives")
    best = kept.groupBy(*by, "always", "all_negatives").agg(F.min(F.when(fine, F.col("threshold"))).alias("kept"), F.max("threshold").alias("top"))
    beyond = next_after(F.when(F.col("kept").isNull() & (F.col("always") <= budget * F.col("all_negatives")), F.coalesce("top", F.lit(1.0))))
    return best.select(*by, F.coalesce("kept", beyond).alias("threshold"))


def high_thresholds(df: DataFrame, low: float, cap: float) -> DataFrame:
    """Candidate high thresholds: just above each negative's score, above
    ``low`` and above all scores, if beyond ``low`` and within the share ``cap``
    of false positives (rounded down)."""
    top = F.greatest(F.lit(1.0), F.max("score"))
    whole = df.agg(count_if(F.col("label") == 0).alias("negatives"), top.alias("top"))
    points = df.where("label = 0").select("score").unionByName(whole.select(F.col("top").alias("score")))
    points = points.unionByName(whole.select(F.lit(low).alias("score"))).distinct()  # one row each
    marks = df.where("label = 0").groupBy("score").agg(F.count("*").alias("q")).unionByName(points.select("score", F.lit(0).alias("q")))
    marks = marks.groupBy("score").agg(F.sum("q").alias("q"), F.max(F.col("q") == 0).alias("point"))
    above = running(marks, [], "score", {"upto": "q"}).where("point").withColumn("false_positives", F.col("upto") - F.col("q"))
    fine = F.col("false_positives") <= F.floor(F.lit(cap) * F.col("negatives") + 1e-12)
    return above.crossJoin(F.broadcast(whole)).where(fine & (F.col("score") >= low)).select(next_after(F.col("score")).alias("threshold"), "false_positives")


def critical_slices(before: DataFrame, after: DataFrame, fields: Sequence[str], least: int = 20) -> DataFrame:
    """Change of recall per slice with ``least`` positives in the baseline; the
    smallest is the critical loss."""
    of = lambda df, name: slices(df, fields).select("field", "value", (F.col("tp") + F.col("fn")).alias(f"{name}_positives"), F.col("recall").alias(name))
    both = of(before, "baseline_recall").join(of(after, "candidate_recall"), ["field", "value"])
    both = both.where(F.col("baseline_recall_positives") >= least)
    delta = F.col("candidate_recall") - F.col("baseline_recall")
    return both.select("field", "value", F.col("baseline_recall_positives").alias("positives"), "baseline_recall", "candidate_recall", delta.alias("delta"))


def threshold_for_precision(df: DataFrame, floor: float, by: Sequence[str] = ()) -> DataFrame:
    """Of thresholds with precision at the floor or over it, the one of largest
    recall; among equals the highest threshold."""
    c = curve(df, by).where(F.col("precision") >= floor)
    return c.groupBy(*by).agg(F.max(F.struct("recall", "threshold")).alias("b")).select(*by, "b.threshold", "b.recall")


def threshold_for_recall(df: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """The highest threshold whose recall reaches the target."""
    c = curve(df, by).where(F.col("tp") >= F.ceil(F.lit(target) * F.col("positives")))
    return c.groupBy(*by).agg(F.max("threshold").alias("threshold"))


def tpr_at_fpr(df: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    return curve(df, by).groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("fpr") <= target, F.col("recall"))), F.lit(0.0)).alias("tpr"))


def best_thresholds(df: DataFrame, most_fpr: float, most_miss: float) -> DataFrame:
    """Flag threshold: most true positives within an FPR, then fewest false
    ones, then the highest. Clear threshold: most negatives below it while at
    most a share of positives is missed, then the lowest."""
    c = curve(df)
    flag = c.where(F.col("fp") <= most_fpr * F.col("negatives")).agg(
        F.max(F.struct("tp", (-F.col("fp")).alias("nfp"), "threshold")).alias("f")
    )
    cleared = F.col("negatives") - F.col("fp")
    clear = c.where(F.col("positives") - F.col("tp") <= most_miss * F.col("positives")).agg(
        F.max(F.struct(cleared.alias("cleared"), (-F.col("threshold")).alias("nt"))).alias("c")
    )
    return flag.crossJoin(clear).select(
        F.col("f.threshold").alias("flag_threshold"), F.col("f.tp").alias("flag_tp"), (-F.col("c.nt")).alias("clear_threshold"), F.col("c.cleared").alias("cleared")
    )


def slices(df: DataFrame, fields: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Metrics per (field, value) over many, possibly multi-valued fields in
    one pass; an empty or null value is '(none)'."""
    kinds = dict(df.dtypes)

    def values(f: str) -> Column:
        arr = F.col(f) if kinds[f].startswith("array") else F.array(F.col(f).cast("string"))
        arr = F.filter(F.coalesce(arr, F.array().cast("array<string>")), lambda v: v.isNotNull())
        return F.when(F.size(arr) > 0, arr).otherwise(F.array(F.lit("(none)")))

    long = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), values(f).alias("values")) for f in fields)))
    flat = df.select("label", "score", long.alias("s")).select("label", "score", "s.field", F.explode("s.values").alias("value"))
    return binary_metrics(flat, ["field", "value"], threshold)


def max_pool(windows: DataFrame, key: str, stable: Sequence[str]) -> DataFrame:
    """Artifacts from windows: largest score, window count, stable fields, and
    whether one of these differs within an artifact (it must not)."""
    return windows.groupBy(key).agg(
        F.max("score").alias("score"),
        F.count("*").alias("windows"),
        *(F.min(c).alias(c) for c in stable),
        F.greatest(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in stable), F.lit(1)).alias("variants"),
    )


def cluster_rates(df: DataFrame, group: str, threshold: float) -> DataFrame:
    """Recall and FPR in which every group weighs the same."""
    flag = F.avg((F.col("score") >= threshold).cast("double")).alias("rate")
    g = df.groupBy(group).agg(flag, F.max("label").alias("label"))
    return g.agg(F.avg(F.when(F.col("label") == 1, F.col("rate"))).alias("recall"), F.avg(F.when(F.col("label") == 0, F.col("rate"))).alias("fpr"))


def macro(df: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """Unweighted mean, least and largest recall and FPR over groups, nulls left out."""
    m = binary_metrics(df, [by], threshold)
    return m.agg(*(f(c).alias(f"{n}_{c}") for c in ("recall", "fpr") for n, f in (("macro", F.avg), ("min", F.min), ("max", F.max))))


def pair_metrics(df: DataFrame, pair: str, threshold: float) -> DataFrame:
    """Benign against attack member of each pair: ordering, gap, both right."""
    wide = df.groupBy(pair).agg(*(F.max(F.when(F.col("label") == k, F.col("score"))).alias(f"s{k}") for k in (0, 1)))
    wide = wide.where("s0 IS NOT NULL AND s1 IS NOT NULL")
    right = (F.col("s1") >= threshold) & (F.col("s0") < threshold)
    return wide.agg(
        F.count("*").alias("pairs"),
        F.avg((F.col("s1") > F.col("s0")).cast("double")).alias("ordering_rate"),
        F.avg(F.col("s1") - F.col("s0")).alias("mean_gap"),
        F.avg(right.cast("double")).alias("both_correct"),
    )


def paired_outcomes(df: DataFrame, pair: str, variant: str, first: str, second: str, threshold: float) -> DataFrame:
    """Contingency of the flags of two variants of the same pair."""
    flag = F.col("score") >= threshold
    wide = df.groupBy(pair).agg(*(F.bool_or(F.when(F.col(variant) == v, flag)).alias(n) for v, n in ((first, "a"), (second, "b"))))
    wide = wide.where("a IS NOT NULL AND b IS NOT NULL")
    return wide.groupBy("a", "b").agg(F.count("*").alias("pairs"))


def quantile_summary(df: DataFrame, column: str, by: Sequence[str] = (), points: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    q = df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.percentile(column, F.array(*map(F.lit, points))).alias("q"))
    return q.select(*by, "n", "mean", *(F.col("q")[k].alias(f"p{round(100 * p)}") for k, p in enumerate(points)))


def nearest_rank(df: DataFrame, column: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """The value at rank round((n - 1) q), halves to even, without interpolation."""
    ties = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    all_of = ties.groupBy(*by).agg(F.sum("__n").alias("__m"))
    ranked = running(ties, by, column, {"__upto": "__n"}, descending=False)
    ranked = ranked.join(F.broadcast(all_of), list(by)) if by else ranked.crossJoin(F.broadcast(all_of))  # one row without groups
    at = F.bround((F.col("__m") - 1) * q)
    return ranked.where((at < F.col("__upto")) & (at >= F.col("__upto") - F.col("__n"))).select(*by, F.col(column).alias("value"))


def prevalence_projection(rates: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Expected precision and alerts of a detector at other shares of attacks."""
    dim = F.explode(F.array(*map(F.lit, shares))).alias("prevalence")
    r = rates.select("*", dim)
    tp, fp = F.col("prevalence") * F.col("recall"), (1 - F.col("prevalence")) * F.col("fpr")
    return r.withColumns({"expected_precision": ratio(tp, tp + fp), "alerts_per_10k": 10_000 * (tp + fp)})


def asr_at_k(df: DataFrame, base: str, ks: Sequence[int]) -> DataFrame:
    """Mean over bases of the chance that k draws without replacement of its
    variants hold a success: 1 - C(n - c, k) / C(n, k), exactly by products."""
    counts = df.groupBy(base).agg(F.count("*").alias("n"), count_if(F.col("success")).alias("c"))
    rows = counts.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("k <= n")
    miss = F.aggregate(
        F.sequence(F.lit(0), F.col("k") - 1),
        F.lit(1.0),
        lambda acc, i: acc * F.greatest(F.col("n") - F.col("c") - i, F.lit(0)).cast("double") / (F.col("n") - i),
    )
    return rows.groupBy("k").agg(F.count("*").alias("bases"), F.avg(1 - miss).alias("asr"))
