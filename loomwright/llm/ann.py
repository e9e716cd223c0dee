"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are normalised, turned by one random rotation and dealt to the lists
of their nearest centroids; a query probes the lists nearest to it. Within a
list, vectors stand in column blocks: after each block of dimensions a
hypothesis test on the partial distance, which a random rotation makes an
estimate of the whole one, abandons candidates that are too far with high
confidence. Survivors are scored exactly on the original vectors. Centroids
are fitted on a bounded sample; every vector is indexed. Long lists are split
into blocks and the queries of a popular list into chunks, so a task holds a
bounded number of both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomwright.llm.common import small_batches, stored

#: Sampled vectors to fit centroids on, lists at most, vectors a list should have.
SAMPLE, LISTS, LIST_ROWS = 32_768, 2048, 512
#: Vectors in a block and queries in a chunk.
BLOCK_ROWS, CHUNK_ROWS = 4096, 256
#: Queries probe so many lists that this share of the sample's neighbour pairs is met; sampled queries for that.
COVERAGE, TRIALS = 0.97, 256
#: Dimensions of a column block, and the confidence of the abandoning test.
COLUMNS, EPSILON = 16, 2.1
SEED = 7


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of huge and tiny values in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; an empty list keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        for d in range(len(c)):
            if (own := x[near == d]).size and (n := np.linalg.norm(s := own.sum(axis=0))) > 0:
                c[d] = s / n
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, k: int, coverage: float) -> int:
    """How many lists, nearest first, hold ``coverage`` of the k nearest of
    sampled queries among the sample. Neighbours in the whole table are nearer
    than those in a sample, so this errs towards more lists."""
    near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    ranks = []
    for i in range(0, len(x), max(1, len(x) // TRIALS)):
        s = x @ x[i]
        s[i] = -2
        best = np.argpartition(-s, min(k, len(s)) - 1)[:k]
        place = np.empty(len(c), int)
        place[np.argsort(-(c @ x[i]), kind="stable")] = np.arange(len(c))
        ranks += place[near[best]].tolist()
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(coverage * len(ranks))) - 1)]) + 1


def scan(ids: np.ndarray, x: np.ndarray, turned: np.ndarray, qid: int, q: np.ndarray, q_turned: np.ndarray, k: int, epsilon: float = EPSILON) -> list[tuple[float, int]]:
    """The k nearest of one block for one query: (cosine, id). With an infinite
    ``epsilon`` nothing is abandoned before its whole distance is known."""
    own = ids != qid
    at = np.nonzero(own)[0]
    if not len(at):
        return []
    dim = turned.shape[1]
    exact = lambda rows: (x[rows] * q).sum(axis=1)
    if len(at) > 4 * k:
        part = ((turned[at, :COLUMNS] - q_turned[:COLUMNS]) ** 2).sum(axis=1)
        first = at[np.argpartition(part, k - 1)[:k]]
        limit = 2 - 2 * float(exact(first).min()) + 1e-6  # the k-th best distance so far
        d = min(COLUMNS, dim)
        while True:
            keep = part <= limit * d / dim * (1 + epsilon / np.sqrt(d)) ** 2 if d < dim else part <= limit
            at, part = at[keep], part[keep]
            if d >= dim or len(at) <= 4 * k:
                break
            upto = min(d + COLUMNS, dim)
            part = part + ((turned[at, d:upto] - q_turned[d:upto]) ** 2).sum(axis=1)
            d = upto
        at = np.union1d(at, first)
    score = exact(at)
    best = np.lexsort((ids[at], -score))[:k]
    return [(float(score[b]), int(ids[at[b]])) for b in best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", coverage: float = COVERAGE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest by cosine.

    Vectors that are null, empty or zero or hold null or non-finite components
    take no part, nor do rows without an id; vectors meet only those of their
    own length. Of rows that repeat an id the smallest vector, in order of its
    components, counts, as a query if any of them is one. With fewer candidates
    than k, all are returned; an empty table gives no rows; other columns are
    ignored whatever their names. Ties go to the smaller id. ``coverage`` of 1
    is exact: all lists are probed and nothing is abandoned early."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(f"`{vec_col}`").cast("array<double>")
    clean = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("q"))
    clean = clean.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    if not clean.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        clean = stored(clean.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q")), "ann-vectors")
    epsilon = EPSILON if coverage < 1 else float("inf")
    dims = clean.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, total = (dims.dim, dims.n) if dims else (1, 0)
    lists = int(min(LISTS, max(1, -(-total // LIST_ROWS))))
    picked = clean.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).select("v")
    sample = picked.toPandas()["v"]
    x = unit(np.stack(sample.to_numpy())) if len(sample) else np.ones((1, dim))
    centroids = fit_centroids(x, lists)
    least_lists = probes_needed(x, centroids, k, coverage) if coverage < 1 else len(centroids)
    shared = spark.sparkContext.broadcast((centroids, dim))

    @F.arrow_udf("int")
    def list_of(col: pa.Array) -> pa.Array:
        c, d = shared.value
        rows = col.to_pylist()
        fit = [i for i, r in enumerate(rows) if len(r) == d]
        out = np.full(len(rows), -1, np.int32)  # vectors of other lengths have a list of their own length
        if fit:
            out[fit] = (unit(np.array([rows[i] for i in fit])) @ c.T).argmax(axis=1)
        return pa.array(out)

    dealt = stored(clean.withColumns({"dim": F.size("v"), "list": list_of("v")}), "ann-lists")
    sizes = {(r.dim, r.list): r.n for r in dealt.groupBy("dim", "list").agg(F.count("*").alias("n")).collect()}
    probes_of = spark.sparkContext.broadcast((sizes, least_lists))

    @F.arrow_udf("array<int>")
    def probes(col: pa.Array) -> pa.Array:
        (c, d), (n_of, least) = shared.value, probes_of.value
        out = []
        for r in col.to_pylist():
            if len(r) != d:
                out.append([-1])
                continue
            got, rows = [], 0
            for i in np.argsort(-(c @ unit(np.array([r]))[0]), kind="stable").tolist():
                if (n := n_of.get((d, i), 0)) == 0:
                    continue
                if len(got) >= least and rows > k:
                    break
                got.append(i)
                rows += n
            out.append(got)
        return pa.array(out, pa.list_(pa.int32()))

    asked = stored(dealt.where("q").select("dim", F.col("vec_id").alias("query_id"), "v", F.explode(probes("v")).alias("list")), "ann-probes")
    askers = asked.groupBy("dim", "list").agg(F.count("*").alias("asks"))
    plan = dealt.groupBy("dim", "list").agg(F.count("*").alias("n")).join(askers, ["dim", "list"])
    plan = F.broadcast(  # one row per list: at most LISTS, and one per other length
        plan.select("dim", "list", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("asks") / CHUNK_ROWS).cast("int").alias("chunks"))
    )
    spread = lambda col, n: F.pmod(F.xxhash64(F.col(col), F.lit(SEED + 1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["dim", "list", "block", "chunk"]
    base = dealt.join(plan, ["dim", "list"]).select("dim", "list", spread("vec_id", "blocks").alias("block"), every("chunks").alias("chunk"), "vec_id", "v")
    ask = asked.join(plan, ["dim", "list"]).select("dim", "list", every("blocks").alias("block"), spread("query_id", "chunks").alias("chunk"), "query_id", "v")

    def local(base_rows: pd.DataFrame, ask_rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(base_rows) and len(ask_rows):
            base_rows = base_rows.sort_values("vec_id", kind="stable")
            ids, x = base_rows.vec_id.to_numpy(), unit(np.stack(base_rows.v.to_numpy()))
            turn = rotation(x.shape[1])
            q = unit(np.stack(ask_rows.v.to_numpy()))
            turned, q_turned = x @ turn, q @ turn
            for i, qid in enumerate(ask_rows.query_id.tolist()):
                found += [(qid, i_, s) for s, i_ in scan(ids, x, turned, qid, q[i], q_turned[i], k, epsilon)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    hits = ask.groupBy(*key).cogroup(base.groupBy(*key)).applyInPandas(lambda a, b: local(b, a), "query_id long, vec_id long, score double")
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
