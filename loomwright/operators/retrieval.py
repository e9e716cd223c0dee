"""Hybrid retrieval: exact dense top-k, BM25, rank fusion, balanced packets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomwright.functions.numeric import dot

RRF_K, RRF_MOST, K1, B = 60, 50, 1.2, 0.75


#: Rows of the bank and queries that one task multiplies.
BANK_ROWS, QUERY_ROWS = 1 << 15, 1 << 10


def dense_top_k(queries: DataFrame, bank: DataFrame, k: int, parts: Sequence[str] = ()) -> DataFrame:
    """(query_id, id, score, rank): largest inner products, within equal
    ``parts``; ties by id. A stated query set against all rows, as products of
    blocks: a task multiplies one block of the bank with one of the queries
    and keeps each query's k best, so no pair leaves it that is not among them."""
    n_bank, n_queries = (df.agg(F.count("*")).first()[0] for df in (bank, queries))
    blocks, chunks = max(1, -(-n_bank // BANK_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    deal = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    q = queries.select("query_id", "vector", *parts, deal("query_id", chunks, "chunk"), every(blocks, "block"))
    b = bank.select("id", "vector", *parts, deal("id", blocks, "block"), every(chunks, "chunk"))

    def multiply(base: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(base) and len(ask):
            base = base.sort_values("id", kind="stable")
            ids, scores = base.id.to_numpy(), np.stack(ask.vector.to_numpy()).astype(np.float64) @ np.stack(base.vector.to_numpy()).astype(np.float64).T
            for own, row in zip(ask.query_id.tolist(), scores, strict=True):
                row = np.where(ids == own, -np.inf, row)
                near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                near = near[ids[near] != own]
                out += [(own, ids[i], row[i]) for i in near[np.lexsort((ids[near], -row[near]))][:k]]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    kinds = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(bank.dtypes)['id']}, score double"
    key = ["block", "chunk", *parts]
    best = b.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(multiply, kinds)
    w = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings(docs: DataFrame, tokens: Column, *keep: str, terms: DataFrame | None = None) -> DataFrame:
    """term, id, tf and document length; texts without terms have no postings.
    With ``terms`` (a column term) only those are posted: all others go before
    anything is grouped."""
    t = docs.select("id", *keep, tokens.alias("t")).withColumn("dl", F.size("t"))
    flat = t.select("id", *keep, "dl", F.explode("t").alias("term"))
    if terms is not None:
        flat = flat.join(terms.select("term").distinct(), "term", "left_semi")
    return flat.groupBy("term", "id", "dl", *keep).agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, posts: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) from query terms (query_id, term), postings
    and one row of totals (n, avgdl). Only the queries' terms are weighed."""
    terms = queries.select("query_id", "term").distinct()
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weights = terms.join(df, "term").crossJoin(F.broadcast(totals)).select("query_id", "term", idf.alias("idf"), "avgdl")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = weights.join(posts, "term").groupBy("query_id", "id").agg(F.sum(F.col("idf") * tf).alias("score"))
    w = W.Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fused(rankings: Sequence[tuple[DataFrame, float]], most: int = RRF_MOST) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) rankings with weights."""
    parts = [r.select("query_id", "id", (F.lit(float(w)) / (RRF_K + F.col("rank"))).alias("s")) for r, w in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    s = union.groupBy("query_id", "id").agg(F.sum("s").alias("score"))
    w = W.Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def lineage_diverse(ranked: DataFrame, lineage: str, k: int) -> DataFrame:
    """The best of each lineage, ranked anew, the first k."""
    first = W.Window.partitionBy("query_id", lineage).orderBy("rank")
    again = W.Window.partitionBy("query_id").orderBy("rank")
    d = ranked.withColumn("__f", F.row_number().over(first)).where("__f = 1").drop("__f")
    return d.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def packets(ranked: DataFrame, rounds: int = 2) -> DataFrame:
    """Balanced example packets from fused rankings (query_id, id, label, source,
    lineage, rank): labels in turn, unused sources first, no lineage twice; a
    query that cannot fill its packet gets none. Lists are RRF_MOST per label."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, sources, lineages = pdf.sort_values(["rank", "id"]), [], set(), set()
        for _ in range(rounds):
            for label in (0, 1):
                free = pdf[(pdf.label == label) & ~pdf.lineage.isin(lineages)]
                if free.empty:
                    return pd.DataFrame(columns=["query_id", "place", "id", "label"])
                fresh = free[~free.source.isin(sources)]
                r = (fresh if len(fresh) else free).iloc[0]
                sources.add(r.source)
                lineages.add(r.lineage)
                out.append((r.query_id, len(out), r.id, label))
        return pd.DataFrame(out, columns=["query_id", "place", "id", "label"])

    kind = dict(ranked.dtypes)
    return ranked.groupBy("query_id").applyInPandas(pick, f"query_id {kind['query_id']}, place int, id {kind['id']}, label int")


def ranking_agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per query the share of b's first k that a has, and whether orders match."""
    top = lambda r, n: r.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(n)
    )
    both = top(a, "x").join(top(b, "y"), "query_id")
    return both.select("query_id", (F.size(F.array_intersect("x", "y")) / F.size("y")).alias("recall"), (F.col("x") == F.col("y")).alias("same_order"))


def max_sim(q: Column, d: Column) -> Column:
    """Late interaction: for each query token vector its best document token, summed."""
    best = lambda u: F.array_max(F.transform(d, lambda v: dot(u, v)))
    return F.aggregate(F.transform(q, best), F.lit(0.0), lambda s, x: s + x)
