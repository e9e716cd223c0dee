"""Audit queries: held-out filters, component names, thresholds around invalid rows, slice losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators import corpus as C
from loomwright.operators import metrics as M
from loomwright.operators.storage import stored
from loomwright.plans.base import CANONICAL_SQL, SCORED_SQL, STRICT_SQL, canonical_rows, hash_unit, hash_unit_sql, scored
from loomwright.plans.registry import load, query, spread


@query("held_out_filter")
def held_out_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the benchmark as held-out texts: exact, strict, near,
    then repeats among themselves."""
    docs, bench = load(spark, sf_dir, "documents", "benchmark")
    t = F.col("text")
    values = lambda df: df.withColumns({"hash": X.text_hash(t), "strict": X.leakage_hash(t), "fp": X.window_fingerprint(t)}).drop("text")
    rows = stored(values(spread(docs.select(F.col("doc_id").alias("id"), "text"))), "held-out-values")
    return C.held_out_filter(rows, stored(values(bench.select("text")), "held-out-values")).withColumnRenamed("id", "doc_id")


@query(
    "component_ids",
    f"""WITH {CANONICAL_SQL}, {STRICT_SQL}
    SELECT group_id, 'validation-component:' || sha256(string_agg(id || chr(0) || sh || chr(10), '' ORDER BY id)) AS component_id, count(*) AS rows
    FROM canon JOIN strict USING (doc_id) GROUP BY group_id""",
)
def component_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical_rows(spark, sf_dir).select("id", "group_id", X.leakage_hash(F.col("text")).alias("strict"))
    return C.component_ids(rows, "group_id")


@query(
    "threshold_with_invalid",
    f"""WITH {SCORED_SQL}, x AS (SELECT *, doc_id % 31 = 0 AS invalid FROM scored),
    n AS (SELECT channel, count_if(label = 0) AS negatives, count_if(label = 0 AND invalid) AS a FROM x GROUP BY channel),
    t AS (SELECT channel, score, count_if(label = 0) AS q FROM x WHERE NOT invalid GROUP BY ALL),
    k AS (SELECT channel, score, sum(q) OVER (PARTITION BY channel ORDER BY score DESC) AS fp FROM t)
    SELECT channel, coalesce(min(CASE WHEN a + fp <= 0.1 * negatives THEN score END), CASE WHEN max(a) <= 0.1 * max(negatives) THEN nextafter(max(score), 'Infinity'::DOUBLE) END) AS threshold
    FROM n JOIN k USING (channel) GROUP BY channel""",
)
def threshold_with_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_with_invalid(scored(spark, sf_dir).withColumn("invalid", F.col("doc_id") % 31 == 0), 0.1, ["channel"])


@query(
    "high_thresholds",
    f"""WITH {SCORED_SQL}, n AS (SELECT count_if(label = 0) AS negatives, greatest(1.0, max(score)) AS top FROM scored),
    c AS (SELECT DISTINCT score AS s FROM scored WHERE label = 0 UNION SELECT top FROM n UNION SELECT 0.4::DOUBLE),
    f AS (SELECT c.s, count(x.score) AS fp FROM c LEFT JOIN (SELECT score FROM scored WHERE label = 0) x ON x.score > c.s GROUP BY c.s)
    SELECT nextafter(s, 'Infinity'::DOUBLE) AS threshold, fp AS false_positives FROM f, n WHERE s >= 0.4 AND fp <= floor(0.05 * negatives + 1e-12)""",
)
def high_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.high_thresholds(scored(spark, sf_dir), 0.4, 0.05)


@query(
    "critical_slice_loss",
    f"""WITH {SCORED_SQL}, x AS (SELECT *, {hash_unit_sql("'c' || doc_id")} AS other FROM scored WHERE label = 1),
    l AS (SELECT 'channel' AS field, channel AS value, score, other FROM x UNION ALL SELECT 'source', source, score, other FROM x UNION ALL SELECT 'lang', lang, score, other FROM x),
    g AS (SELECT field, value, count(*) AS positives, count_if(score >= 0.5) / count(*)::DOUBLE AS b, count_if(other >= 0.5) / count(*)::DOUBLE AS a FROM l GROUP BY ALL)
    SELECT field, value, positives, round(b, 9) AS baseline_recall, round(a, 9) AS candidate_recall, round(a - b, 9) AS delta FROM g WHERE positives >= 20""",
)
def critical_slice_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a second scorer against the first, on slices with 20 positives or more."""
    before = scored(spark, sf_dir)
    after = before.withColumn("score", hash_unit(F.concat(F.lit("c"), "doc_id")))
    out = M.critical_slices(before, after, ["channel", "source", "lang"])
    return out.withColumns({c: F.round(c, 9) for c in ("baseline_recall", "candidate_recall", "delta")})


@query(
    "mutation_population",
    """WITH p AS (SELECT item_id, f.family, r.repeat FROM benchmark, (SELECT unnest(['case', 'whitespace', 'duplication']) AS family) f, (SELECT unnest(range(3)) AS repeat) r)
    SELECT item_id, family, repeat::INT AS repeat, sha256(item_id || chr(0) || family || chr(0) || repeat) AS mutation_id FROM p""",
)
def mutation_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with every mutation family and repeat: a product with two fixed lists."""
    (bench,) = load(spark, sf_dir, "benchmark")
    rows = bench.select("item_id", F.explode(F.array(*map(F.lit, ("case", "whitespace", "duplication")))).alias("family"))
    rows = rows.select("item_id", "family", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("repeat"))
    return rows.withColumn("mutation_id", F.sha2(F.concat_ws("\0", "item_id", "family", "repeat"), 256))
