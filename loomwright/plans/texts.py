"""Scalar text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import numeric as N
from loomwright.functions import text as X
from loomwright.plans.base import NORM_SQL, STRICT_SQL, hash_unit, hash_unit_sql
from loomwright.plans.registry import load, query, spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents")[0])


@query("normalized_text_hash", f"SELECT doc_id, sha256({NORM_SQL}) AS h, length({NORM_SQL}) AS n FROM documents")
def normalized_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.normalize_text(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(n, 256).alias("h"), F.length(n).alias("n"))


@query("invisible_and_lookalike_folding", "SELECT doc_id, sha256(text) AS h FROM documents")
def invisible_and_lookalike_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without such code points stay as they are."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.fold_lookalikes(X.strip_invisible(F.col("text"))), 256).alias("h"))


@query("strip_combining_marks", "SELECT doc_id, sha256(replace(strip_accents(text), 'ß', 'ß')) AS h FROM documents")
def strip_combining_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.strip_combining(F.col("text")), 256).alias("h"))


@query(
    "collapse_repeats",
    """WITH c AS (SELECT doc_id, string_split(text, '') AS l FROM documents)
    SELECT doc_id, len(list_filter(l, lambda x, i: i <= 3 OR x <> l[i-1] OR x <> l[i-2] OR x <> l[i-3])) AS n FROM c""",
)
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.length(X.collapse_repeats(F.col("text"))).alias("n"))


@query("leakage_hash", f"WITH {STRICT_SQL} SELECT doc_id, sh AS h FROM strict")
def leakage_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.leakage_hash(F.col("text")).alias("h"))


@query("fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.window_fingerprint(F.col("text")).alias("fp")).select("doc_id", "fp.lo", "fp.hi")


@query("overlap_triples")
def overlap_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised hash, strict hash and fingerprint in one pass."""
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.text_hash(t).alias("normalized"), X.leakage_hash(t).alias("strict"), X.window_fingerprint(t).alias("fp"))


@query("length_buckets", "SELECT CASE WHEN length(text)<=256 THEN 'short' WHEN length(text)<=1024 THEN 'medium' WHEN length(text)<=4096 THEN 'long' ELSE 'very_long' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(X.length_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query("word_counts", "SELECT doc_id, len(regexp_extract_all(text, '[\\pL\\pN_]+')) AS words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.word_total(F.col("text")).alias("words"))


@query("paragraph_max_score", f"""WITH b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p)), lambda p: length(p) >= 8) AS l, text FROM documents),
p AS (SELECT doc_id, unnest(CASE WHEN len(l) > 0 THEN l ELSE [text] END) AS p FROM b) SELECT doc_id, count(*) AS paragraphs, round(max({hash_unit_sql("p")}),9) AS score FROM p GROUP BY doc_id""")
def paragraph_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of the worst paragraph of each text."""
    p = _docs(spark, sf_dir).select("doc_id", F.explode(X.paragraphs(F.col("text"))).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.round(F.max(hash_unit(F.col("p"))), 9).alias("score"))


@query("sensitive_reasons")
def sensitive_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _docs(spark, sf_dir).select("doc_id", X.sensitive_reasons(F.col("text")).alias("reasons"))
    return r.withColumn("quarantined", F.size("reasons") > 0)


PLAIN_PATTERNS = ("credential_value", "email_address", "iban", "phone_number", "private_key", "provider_token", "street_address")


def _pattern_sql(name: str) -> str:
    return "count_if(regexp_matches(text, '" + X.SENSITIVE[name].replace("'", "''") + f"')) AS {name}"


@query("sensitive_pattern_counts", "SELECT source, " + ", ".join(map(_pattern_sql, PLAIN_PATTERNS)) + " FROM documents GROUP BY source")
def sensitive_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = [F.count_if(X.nfkc(F.col("text")).rlike(X.sensitive_pattern(n))).alias(n) for n in PLAIN_PATTERNS]
    return _docs(spark, sf_dir).groupBy("source").agg(*hits)


@query("redacted_lengths")
def redacted_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.length(X.redacted(F.col("text"))).alias("n"))


@query("keyword_detector", "SELECT role, count_if(" + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in X.KEYWORDS) + ") AS hits, count(*) AS n FROM conversations GROUP BY role")
def keyword_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = load(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count_if(X.keyword_hit(F.lower("text"))).alias("hits"), F.count("*").alias("n"))


@query("exact_match_detector", f"WITH b AS (SELECT DISTINCT {NORM_SQL} AS k FROM benchmark) SELECT doc_id, {NORM_SQL} IN (SELECT k FROM b) AS hit FROM documents")
def exact_match_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = load(spark, sf_dir, "documents", "benchmark")
    known = b.select(X.text_hash(F.col("text")).alias("h")).distinct().withColumn("hit", F.lit(True))
    return d.withColumn("h", X.text_hash(F.col("text"))).join(known, "h", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("token_windows", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 32 - 1, 0) + 1, 224)) AS start FROM w)
SELECT doc_id, start, len(t[start+1:start+256]) AS n FROM s""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _docs(spark, sf_dir).select("doc_id", F.explode(X.windows(F.col("text"), 256, 32)).alias("w"))
    return w.select("doc_id", "w.start", F.size("w.words").alias("n"))


@query("attack_insertion", """WITH p AS (SELECT unnest(['start','middle','end']) AS position)
SELECT item_id, position, sha256(CASE position WHEN 'start' THEN 'ATTACK' || chr(10) || text WHEN 'end' THEN text || chr(10) || 'ATTACK'
ELSE substr(text,1,(length(text)//2)::INT) || chr(10) || 'ATTACK' || chr(10) || substr(text,(length(text)//2)::INT+1) END) AS h FROM benchmark, p""")
def attack_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every context with the attack at each of three positions."""
    (b,) = load(spark, sf_dir, "benchmark")
    rows = b.select("item_id", "text", F.explode(F.array(F.lit("start"), F.lit("middle"), F.lit("end"))).alias("position"))
    return rows.select("item_id", "position", F.sha2(X.insert_at(F.col("text"), F.lit("ATTACK"), F.col("position")), 256).alias("h"))


@query("sigmoid_of_log_odds", f"SELECT doc_id, round(1/(1+exp(-(8*{hash_unit_sql('doc_id')}-4))),9) AS p FROM documents")
def sigmoid_of_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(N.sigmoid(8 * hash_unit(F.col("doc_id")) - 4), 9).alias("p"))


@query("canonical_json_digest")
def canonical_json_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", X.json_digest(("source", F.col("source")), ("lang", F.col("lang")), ("n", F.col("n_chars"))).alias("h"))


@query("strict_json", "SELECT count(*) AS n, count_if(json_valid(props)) AS valid FROM events")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = load(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("n"), F.count_if(X.strict_json_error(F.col("props")).isNull()).alias("valid"))


@query("excerpt_around_max", f"""WITH w AS (SELECT doc_id, text, list_transform(range(0, 1 + length(text)//500), lambda i: ('0x' || substr(sha256('x-' || doc_id || '-' || i),1,8))::BIGINT) AS s FROM documents)
SELECT doc_id, sha256(substr(text, greatest(1, ((list_position(s, list_max(s)) - 1) * 500 - 100 + 1)::INT), 700)) AS h FROM w""")
def excerpt_around_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compact excerpt around the worst window."""
    s = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 500).cast("int")), lambda i: F.conv(F.substring(F.sha2(F.concat_ws("-", F.lit("x"), "doc_id", i), 256), 1, 8), 16, 10).cast("long"))
    d = _docs(spark, sf_dir).withColumn("s", s)
    at = F.greatest(F.lit(1), (F.array_position("s", F.array_max("s")) - 1) * 500 - 99).cast("int")
    return d.select("doc_id", F.sha2(F.substring(F.col("text"), at, F.lit(700)), 256).alias("h"))
