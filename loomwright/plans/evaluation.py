"""Evaluation queries: rates, rankings, thresholds, slices, projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomwright.functions import numeric as N
from loomwright.operators import metrics as M
from loomwright.plans.base import SCORED_SQL, hash_unit, hash_unit_sql, scored
from loomwright.plans.registry import load, query

Z = "1.959963984540054"


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def _binary_sql(source: str, by: str, threshold: str = "0.5") -> str:
    return f"""
    c AS (SELECT {by}, count(*) AS n, count_if(label=1 AND score>={threshold}) AS tp, count_if(label=0 AND score>={threshold}) AS fp,
      count_if(label=0 AND score<{threshold}) AS tn, count_if(label=1 AND score<{threshold}) AS fn, avg((score-label)*(score-label)) AS brier FROM {source} GROUP BY {by}),
    m AS (SELECT *, tp/nullif(tp+fn,0)::DOUBLE AS recall, fp/nullif(fp+tn,0)::DOUBLE AS fpr, tp/nullif(tp+fp,0)::DOUBLE AS precision, (tp+tn)/n::DOUBLE AS accuracy FROM c)"""


def _wilson_sql(p: str, n: str, sign: str) -> str:
    z = Z
    return f"(({p} + {z}*{z}/(2*nullif({n},0))) / (1 + {z}*{z}/nullif({n},0)) {sign} {z}*sqrt({p}*(1-{p})/nullif({n},0) + {z}*{z}/(4.0*nullif({n},0)*{n}))/(1 + {z}*{z}/nullif({n},0)))"


@query(
    "binary_metrics_by_lang",
    f"""WITH {SCORED_SQL}, {_binary_sql("scored", "lang")}
    SELECT lang, n, tp, fp, tn, fn, round(brier,9) AS brier, round(recall,9) AS recall, round(fpr,9) AS fpr, round(precision,9) AS precision, round(accuracy,9) AS accuracy,
      round(greatest({_wilson_sql("recall", "(tp+fn)", "-")},0),9) AS recall_low, round(least({_wilson_sql("recall", "(tp+fn)", "+")},1),9) AS recall_high,
      round(greatest({_wilson_sql("fpr", "(fp+tn)", "-")},0),9) AS fpr_low, round(least({_wilson_sql("fpr", "(fp+tn)", "+")},1),9) AS fpr_high,
      round(10000*fpr,9) AS fp_per_10k FROM m""",
)
def binary_metrics_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.binary_metrics(scored(spark, sf_dir), ["lang"]))


@query(
    "metrics_by_slice",
    f"""WITH {SCORED_SQL}, x AS (SELECT label, score, unnest([{{'field':'lang','value':lang}}, {{'field':'channel','value':channel}}, {{'field':'source','value':source}}]) AS s FROM scored),
    y AS (SELECT label, score, s.field AS field, s.value AS value FROM x), {_binary_sql("y", "field, value")}
    SELECT field, value, n, tp, fp, tn, fn, round(recall,9) AS recall, round(fpr,9) AS fpr FROM m""",
)
def metrics_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.slices(scored(spark, sf_dir), ["lang", "channel", "source"])).select("field", "value", "n", "tp", "fp", "tn", "fn", "recall", "fpr")


CURVE_SQL = """
t AS (SELECT score, count_if(label=1) AS p, count_if(label=0) AS q FROM scored GROUP BY score),
n AS (SELECT count_if(label=1) AS positives, count_if(label=0) AS negatives FROM scored),
k AS (SELECT t.score AS threshold, p, q, sum(p) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(q) OVER (ORDER BY score DESC)::BIGINT AS fp, positives, negatives FROM t, n)
"""


@query(
    "auroc_and_average_precision",
    f"""WITH {SCORED_SQL}, {CURVE_SQL} SELECT round(sum(p*(negatives-fp+q/2.0))/max(positives)/max(negatives),9) AS auroc,
    round(sum(p*(tp/(tp+fp)::DOUBLE))/max(positives),9) AS average_precision FROM k""",
)
def auroc_and_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.ranking(scored(spark, sf_dir)))


@query(
    "auroc_by_source",
    f"""WITH {SCORED_SQL}, r AS (SELECT source, label, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1)/2.0 AS rk FROM scored)
    SELECT source, round((sum(CASE WHEN label=1 THEN rk END) - count_if(label=1)*(count_if(label=1)+1)/2.0)/nullif(count_if(label=1)*count_if(label=0),0),9) AS auroc FROM r GROUP BY source""",
)
def auroc_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.ranking(scored(spark, sf_dir), ["source"])).select("source", "auroc")


@query(
    "threshold_at_fpr",
    f"""WITH {SCORED_SQL}, {CURVE_SQL}, b AS (SELECT unnest([0.001,0.01,0.05,0.2]) AS budget)
    SELECT budget, coalesce(min(CASE WHEN fp <= budget*negatives THEN threshold END), nextafter(max(threshold), 'Infinity'::DOUBLE)) AS threshold, NOT bool_or(fp <= budget*negatives) AS above FROM k, b GROUP BY budget""",
)
def threshold_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    out = [M.threshold_at_fpr(df, b).withColumn("budget", F.lit(b)) for b in (0.001, 0.01, 0.05, 0.2)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "threshold_for_precision",
    f"""WITH {SCORED_SQL}, {CURVE_SQL} SELECT threshold, round(tp/positives::DOUBLE,9) AS recall FROM k WHERE tp/(tp+fp)::DOUBLE >= 0.5 ORDER BY recall DESC, threshold DESC LIMIT 1""",
)
def threshold_for_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.threshold_for_precision(scored(spark, sf_dir), 0.5))


@query(
    "threshold_for_recall",
    f"""WITH {SCORED_SQL}, {CURVE_SQL} SELECT max(threshold) AS threshold FROM k WHERE tp >= ceil(0.8*positives)""",
)
def threshold_for_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_for_recall(scored(spark, sf_dir), 0.8)


@query(
    "tpr_at_fpr",
    f"""WITH {SCORED_SQL}, {CURVE_SQL} SELECT round(coalesce(max(CASE WHEN fp/negatives::DOUBLE <= 0.1 THEN tp/positives::DOUBLE END),0),9) AS tpr FROM k""",
)
def tpr_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.tpr_at_fpr(scored(spark, sf_dir), 0.1))


@query(
    "flag_and_clear_thresholds",
    f"""WITH {SCORED_SQL}, {CURVE_SQL}, f AS (SELECT threshold, tp FROM k WHERE fp <= 0.05*negatives ORDER BY tp DESC, fp, threshold DESC LIMIT 1),
    c AS (SELECT threshold, negatives-fp AS cleared FROM k WHERE positives-tp <= 0.1*positives ORDER BY cleared DESC, threshold LIMIT 1)
    SELECT f.threshold AS flag_threshold, f.tp AS flag_tp, c.threshold AS clear_threshold, c.cleared FROM f, c""",
)
def flag_and_clear_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_thresholds(scored(spark, sf_dir), 0.05, 0.1)


@query(
    "transported_threshold",
    f"""WITH {SCORED_SQL}, cal AS (SELECT * FROM scored WHERE doc_id % 2 = 0),
    t AS (SELECT score, count_if(label=0) AS q FROM cal GROUP BY score), k AS (SELECT score, sum(q) OVER (ORDER BY score DESC) AS fp FROM t),
    h AS (SELECT min(score) AS threshold FROM k WHERE fp <= 0.1*(SELECT count_if(label=0) FROM cal))
    SELECT h.threshold, count_if(label=1 AND score>=threshold) AS tp, count_if(label=0 AND score>=threshold) AS fp, count(*) AS n FROM scored, h WHERE doc_id % 2 = 1 GROUP BY h.threshold""",
)
def transported_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold chosen on calibration rows, applied to evaluation rows."""
    df = scored(spark, sf_dir)
    chosen = M.threshold_at_fpr(df.where("doc_id % 2 = 0"), 0.1).select("threshold")
    flag = F.col("score") >= F.col("threshold")
    rows = df.where("doc_id % 2 = 1").crossJoin(F.broadcast(chosen))  # one row
    return rows.groupBy("threshold").agg(M.count_if((F.col("label") == 1) & flag).alias("tp"), M.count_if((F.col("label") == 0) & flag).alias("fp"), F.count("*").alias("n"))


@query(
    "component_threshold",
    f"""WITH {SCORED_SQL}, c AS (SELECT channel, group_id, max(score) AS s FROM scored WHERE label=0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY s DESC, group_id) AS k, count(*) OVER (PARTITION BY channel) AS n FROM c)
    SELECT channel, s AS score, n FROM r WHERE k = floor(0.05*n)+1""",
)
def component_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per channel the largest benign component score that the budget does not excuse."""
    c = scored(spark, sf_dir).where("label = 0").groupBy("channel", "group_id").agg(F.max("score").alias("s"))
    w = W.Window.partitionBy("channel")
    r = c.withColumns({"k": F.row_number().over(w.orderBy(F.desc("s"), "group_id")), "n": F.count("*").over(w)})
    return r.where(F.col("k") == F.floor(0.05 * F.col("n")) + 1).select("channel", F.col("s").alias("score"), "n")


@query(
    "cluster_weighted_rates",
    f"""WITH {SCORED_SQL}, g AS (SELECT group_id, avg(CASE WHEN score>=0.5 THEN 1.0 ELSE 0.0 END) AS r, max(label) AS label FROM scored GROUP BY group_id)
    SELECT round(avg(CASE WHEN label=1 THEN r END),9) AS recall, round(avg(CASE WHEN label=0 THEN r END),9) AS fpr FROM g""",
)
def cluster_weighted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.cluster_rates(scored(spark, sf_dir), "group_id", 0.5))


@query(
    "macro_rates",
    f"""WITH {SCORED_SQL}, {_binary_sql("scored", "source")} SELECT round(avg(recall),9) AS macro_recall, round(min(recall),9) AS min_recall, round(max(recall),9) AS max_recall,
    round(avg(fpr),9) AS macro_fpr, round(min(fpr),9) AS min_fpr, round(max(fpr),9) AS max_fpr FROM m""",
)
def macro_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.macro(scored(spark, sf_dir), "source"))


@query(
    "length_band_metrics",
    f"""WITH {SCORED_SQL}, x AS (SELECT *, CASE WHEN length(text)<=256 THEN 'short' WHEN length(text)<=1024 THEN 'medium' WHEN length(text)<=4096 THEN 'long' ELSE 'very_long' END AS band FROM scored),
    {_binary_sql("x", "band")} SELECT band, n, tp, fp, tn, fn FROM m""",
)
def length_band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.functions.text import length_bucket

    return M.confusion(scored(spark, sf_dir).withColumn("band", length_bucket(F.col("text"))), ["band"]).drop("brier")


WINDOWS_SQL = f"""
windows AS (SELECT d.doc_id, w.i AS window_index, round({hash_unit_sql("d.doc_id || '-' || w.i")},4) AS score, l.toxic AS label, d.source
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id, unnest(range(0, 1 + d.n_chars // 1500)) AS w(i))
"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents", "labels")
    rows = docs.join(labels, "doc_id").select("doc_id", F.col("toxic").alias("label"), "source", F.explode(F.expr("sequence(0, n_chars div 1500)")).alias("window_index"))
    return rows.withColumn("score", F.round(hash_unit(F.concat_ws("-", "doc_id", "window_index")), 4))


@query(
    "window_max_pool",
    f"WITH {WINDOWS_SQL} SELECT doc_id, max(score) AS score, count(*) AS windows, min(label) AS label, min(source) AS source, 1 AS variants FROM windows GROUP BY doc_id",
)
def window_max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.max_pool(_windows(spark, sf_dir), "doc_id", ["label", "source"])


@query(
    "pair_metrics",
    f"""WITH {SCORED_SQL}, p AS (SELECT doc_id // 8 AS pair, max(CASE WHEN label=0 THEN score END) AS s0, max(CASE WHEN label=1 THEN score END) AS s1 FROM scored GROUP BY 1)
    SELECT count(*) AS pairs, round(avg((s1>s0)::INT),9) AS ordering_rate, round(avg(s1-s0),9) AS mean_gap, round(avg((s1>=0.5 AND s0<0.5)::INT),9) AS both_correct FROM p WHERE s0 IS NOT NULL AND s1 IS NOT NULL""",
)
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.pair_metrics(scored(spark, sf_dir).withColumn("pair", F.expr("doc_id div 8")), "pair", 0.5))


@query(
    "paired_outcomes",
    f"""WITH {SCORED_SQL}, p AS (SELECT doc_id // 2 AS pair, bool_or(CASE WHEN doc_id%2=0 THEN score>=0.3 END) AS a, bool_or(CASE WHEN doc_id%2=1 THEN score>=0.3 END) AS b FROM scored GROUP BY 1)
    SELECT a, b, count(*) AS pairs FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""",
)
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).withColumns({"pair": F.expr("doc_id div 2"), "variant": F.when(F.col("doc_id") % 2 == 0, "clean").otherwise("attack")})
    return M.paired_outcomes(df, "pair", "variant", "clean", "attack", 0.3)


@query(
    "latency_quantiles",
    "SELECT event_type, count(value) AS n, round(avg(value),6) AS mean, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95, round(quantile_cont(value,0.99),6) AS p99 FROM events GROUP BY event_type",
)
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return rounded(M.quantile_summary(events, "value", ["event_type"]), 6)


@query(
    "nearest_rank_quantile",
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value FROM r WHERE r = round_even((n - 1) * 0.95, 0)",
)
def nearest_rank_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return M.nearest_rank(events, "value", 0.95, ["event_type"])


@query(
    "prevalence_projection",
    f"""WITH {SCORED_SQL}, {_binary_sql("scored", "channel")}, s AS (SELECT unnest([0.001,0.01,0.1]) AS prevalence)
    SELECT channel, prevalence, round(prevalence*recall/nullif(prevalence*recall+(1-prevalence)*fpr,0),9) AS expected_precision, round(10000*(prevalence*recall+(1-prevalence)*fpr),6) AS alerts_per_10k FROM m, s""",
)
def prevalence_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.binary_metrics(scored(spark, sf_dir), ["channel"])
    out = M.prevalence_projection(r, [0.001, 0.01, 0.1])
    return out.select("channel", "prevalence", F.round("expected_precision", 9).alias("expected_precision"), F.round("alerts_per_10k", 6).alias("alerts_per_10k"))


@query(
    "traffic_mix_projection",
    f"""WITH {SCORED_SQL}, {_binary_sql("scored", "channel")}, x(channel, share) AS (VALUES ('direct_user', 0.8), ('untrusted_content', 0.2))
    SELECT round(sum(share*recall),9) AS recall, round(sum(share*fpr),9) AS fpr FROM m JOIN x ON m.channel = x.channel""",
)
def traffic_mix_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = spark.createDataFrame([("direct_user", 0.8), ("untrusted_content", 0.2)], "channel string, share double")
    r = M.binary_metrics(scored(spark, sf_dir), ["channel"]).join(F.broadcast(mix), "channel")
    return rounded(r.agg(F.sum(F.col("share") * F.col("recall")).alias("recall"), F.sum(F.col("share") * F.col("fpr")).alias("fpr")))


@query("asr_at_k")
def asr_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact attack success at k draws over mutations of each base."""
    w = _windows(spark, sf_dir).withColumn("success", F.col("score") < 0.2)
    return rounded(M.asr_at_k(w, "source", [1, 2, 5]))


@query(
    "asr_at_one",
    f"WITH {WINDOWS_SQL}, b AS (SELECT source, avg((score<0.2)::INT) AS r FROM windows GROUP BY source) SELECT 1 AS k, count(*) AS bases, round(avg(r),9) AS asr FROM b",
)
def asr_at_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.asr_at_k(_windows(spark, sf_dir).withColumn("success", F.col("score") < 0.2), "source", [1]))


@query(
    "threshold_grid",
    f"""WITH {SCORED_SQL}, g AS (SELECT a.lo, b.hi FROM (SELECT unnest([0.05,0.1,0.2]) AS lo) a, (SELECT unnest([0.7,0.8,0.9]) AS hi) b),
    r AS (SELECT lo, hi, label, channel, score>=hi OR (score>=lo AND {hash_unit_sql("'rev' || doc_id")} < 0.2 + 0.6*label) AS flag, score>=lo AND score<hi AS called FROM scored, g)
    SELECT lo, hi, count_if(flag AND label=1) AS tp, count_if(flag AND label=0) AS fp, count_if(called) AS calls,
      round(greatest(count_if(flag AND label=0 AND channel='direct_user')/count_if(label=0 AND channel='direct_user')::DOUBLE, count_if(flag AND label=0 AND channel<>'direct_user')/count_if(label=0 AND channel<>'direct_user')::DOUBLE),9) AS max_channel_fpr FROM r GROUP BY ALL""",
)
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (low, high) settings of a cascade in one pass over the panel."""
    grid = spark.createDataFrame([(a, b) for a in (0.05, 0.1, 0.2) for b in (0.7, 0.8, 0.9)], "lo double, hi double")
    df = scored(spark, sf_dir).withColumn("verdict", hash_unit(F.concat(F.lit("rev"), F.col("doc_id"))) < 0.2 + 0.6 * F.col("label"))
    s, y = F.col("score"), F.col("label")
    flag = (s >= F.col("hi")) | ((s >= F.col("lo")) & F.col("verdict"))
    direct = F.col("channel") == "direct_user"
    fpr = lambda c: N.ratio(F.count_if(flag & (y == 0) & c), F.count_if((y == 0) & c))
    return df.crossJoin(F.broadcast(grid)).groupBy("lo", "hi").agg(
        F.count_if(flag & (y == 1)).alias("tp"),
        F.count_if(flag & (y == 0)).alias("fp"),
        F.count_if((s >= F.col("lo")) & (s < F.col("hi"))).alias("calls"),
        F.round(F.greatest(fpr(direct), fpr(~direct)), 9).alias("max_channel_fpr"),
    )


@query(
    "profile_selection",
    f"""WITH {SCORED_SQL}, g AS (SELECT unnest([0.2,0.3,0.4,0.5,0.6]) AS cut), r AS (SELECT cut, source, count_if(label=1 AND score>=cut)/nullif(count_if(label=1),0)::DOUBLE AS rec FROM scored, g GROUP BY ALL),
    t AS (SELECT cut, count_if(label=0 AND score>=cut)/count_if(label=0)::DOUBLE AS fpr, count_if(label=1 AND score>=cut)/count_if(label=1)::DOUBLE AS recall FROM scored, g GROUP BY cut),
    w AS (SELECT cut, min(rec) AS worst FROM r GROUP BY cut)
    SELECT t.cut, round(recall,9) AS recall, round(fpr,9) AS fpr, round(worst,9) AS worst FROM t JOIN w ON t.cut = w.cut WHERE fpr <= 0.6 ORDER BY worst DESC, recall DESC, t.cut LIMIT 1""",
)
def profile_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The setting within an FPR cap of best worst-slice recall, ties by recall, then cut."""
    grid = spark.createDataFrame([(c,) for c in (0.2, 0.3, 0.4, 0.5, 0.6)], "cut double")
    df = scored(spark, sf_dir).crossJoin(F.broadcast(grid))
    flag = F.col("score") >= F.col("cut")
    pos, neg = F.col("label") == 1, F.col("label") == 0
    worst = df.groupBy("cut", "source").agg(N.ratio(F.count_if(pos & flag), F.count_if(pos)).alias("r")).groupBy("cut").agg(F.min("r").alias("worst"))
    t = df.groupBy("cut").agg(N.ratio(F.count_if(neg & flag), F.count_if(neg)).alias("fpr"), N.ratio(F.count_if(pos & flag), F.count_if(pos)).alias("recall"))
    return rounded(t.join(worst, "cut").where("fpr <= 0.6").orderBy(F.desc("worst"), F.desc("recall"), "cut").limit(1))


@query(
    "bce_by_source",
    f"""WITH {SCORED_SQL}, z AS (SELECT source, label AS y, (score-0.5)*8 AS z FROM scored), b AS (SELECT source, avg(greatest(z,0)+ln(1+exp(-abs(z)))-y*z) AS bce FROM z GROUP BY source)
    SELECT source, round(bce,9) AS bce FROM b""",
)
def bce_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (F.col("score") - 0.5) * 8
    return rounded(scored(spark, sf_dir).groupBy("source").agg(F.avg(N.bce_logits(z, F.col("label"))).alias("bce")))


@query(
    "selection_loss",
    f"""WITH {SCORED_SQL}, z AS (SELECT source, label AS y, (score-0.5)*8 AS z FROM scored), e AS (SELECT source, greatest(z,0)+ln(1+exp(-abs(z)))-y*z AS b FROM z),
    s AS (SELECT source, avg(b) AS m FROM e GROUP BY source) SELECT round((SELECT avg(b) FROM e),9) AS micro, round((SELECT avg(m) FROM s),9) AS source_macro""",
)
def selection_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scored(spark, sf_dir).select("source", N.bce_logits((F.col("score") - 0.5) * 8, F.col("label")).alias("b"))
    s = e.groupBy("source").agg(F.avg("b").alias("m"), F.sum("b").alias("t"), F.count("*").alias("n"))
    return rounded(s.agg((F.sum("t") / F.sum("n")).alias("micro"), F.avg("m").alias("source_macro")))


@query(
    "serving_parity",
    f"WITH {SCORED_SQL} SELECT round(max(abs(score - {hash_unit_sql('doc_id')})),9) AS max_abs_error, count_if((score>=0.5) <> ({hash_unit_sql('doc_id')}>=0.5)) AS flips FROM scored",
)
def serving_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = hash_unit(F.col("doc_id"))
    df = scored(spark, sf_dir)
    return rounded(df.agg(F.max(F.abs(F.col("score") - other)).alias("max_abs_error"), F.count_if((F.col("score") >= 0.5) != (other >= 0.5)).alias("flips")))


@query("paired_bootstrap_delta")
def paired_bootstrap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the recall difference of two detectors, by a stratified
    bootstrap: 2,000 draws on the counts of the four outcomes per class, which
    are all that the statistic depends on."""
    df = scored(spark, sf_dir)
    a, b = F.col("score") >= 0.5, hash_unit(F.col("doc_id")) >= 0.5
    cells = df.groupBy("label", a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, out = np.random.default_rng(42), {}
        for label, part in pdf.groupby("label"):
            part = part.sort_values(["a", "b"])
            n = int(part.n.sum())
            d = (part.a.astype(int) - part.b.astype(int)).to_numpy()
            out[label] = rng.multinomial(n, part.n / n, size=2000) @ d / n
        rows = [("recall" if k == 1 else "fpr", float(np.mean(v)), *np.quantile(v, [0.025, 0.975])) for k, v in sorted(out.items())]
        return pd.DataFrame(rows, columns=["metric", "delta", "low", "high"])

    return cells.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(draw, "metric string, delta double, low double, high double")


@query("supported_fp_budget")
def supported_fp_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact upper bounds and the false positives that a 5 % bound allows, per channel."""
    rows = scored(spark, sf_dir).groupBy("channel").agg(F.count_if(F.col("label") == 0).alias("n"), F.count_if((F.col("label") == 0) & (F.col("score") >= 0.65)).alias("fp")).collect()
    out = [(r.channel, r.n, r.fp, N.clopper_pearson_upper(r.fp, r.n), N.supported_budget(r.n, 0.05)) for r in rows if r.n]
    return spark.createDataFrame(out, "channel string, negatives long, fp long, upper double, budget int")
