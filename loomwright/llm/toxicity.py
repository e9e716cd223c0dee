"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees the words of a
document and the probabilities of all categories before it. While training,
those earlier probabilities are out-of-fold predictions, so that a later model
learns from them as it will meet them. Features are word forms and the starts
and ends of words, present or not anywhere in the whole text: a long text is
not diluted. The models are fitted on a sample of labelled rows that the
parameters ``positives`` and ``negatives`` of :func:`train` bound, taken by a
hash of the id; executors count the features and turn the sample into indices
of those chosen, so that only these reach the driver. Scoring covers every
document in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import original, positional, small_batches, stored

#: Labelled rows to fit on at most, with and without the last category, and features.
POSITIVES, NEGATIVES, FEATURES = 3000, 9000, 3000
LEAST_ROWS, FOLDS, ROUNDS, RIDGE = 5, 3, 120, 2e-3
THRESHOLD = 0.5
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 300_000


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def forms(word: str) -> list[str]:
    """Features of a word: itself, its starts and ends; of very long runs of
    letters, as scripts without spaces have them, pairs of letters."""
    if len(word) > 40:
        return sorted({"~" + word[i : i + 2] for i in range(len(word) - 1)})
    ends = ["^" + word[:n] for n in (3, 4, 5, 6) if n < len(word)] + [word[-n:] + "$" for n in (4, 5) if n < len(word)]
    return ["=" + word, *ends]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """A sparse matrix of the rows' scaled features, by row and by feature, with
    dense columns behind it."""

    def __init__(self, hits: Sequence[np.ndarray], scale: np.ndarray, dense: np.ndarray | None = None):
        self.hits, self.scale = list(hits), scale
        self.dense = np.empty((len(self.hits), 0)) if dense is None else dense
        self.at = np.concatenate([np.empty(0, np.int32), *self.hits]).astype(np.int32)
        of = np.repeat(np.arange(len(self.hits), dtype=np.int32), [len(h) for h in self.hits])
        by_feature = np.argsort(self.at, kind="stable")
        self.of = of[by_feature]
        self.rows, self.starts = np.unique(of, return_index=True)
        self.features, self.firsts = np.unique(self.at[by_feature], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        d = len(self.scale)
        out = self.dense @ w[d:-1] + w[-1]
        if len(self.at):
            out[self.rows] += np.add.reduceat((w[:d] * self.scale)[self.at], self.starts)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.scale))
        if len(self.at):
            out[self.features] = np.add.reduceat(r[self.of], self.firsts) * self.scale[self.features]
        return np.concatenate([out, self.dense.T @ r, [r.sum()]])

    def part(self, rows: np.ndarray) -> Rows:
        return Rows([self.hits[i] for i in rows], self.scale, self.dense[rows])

    def wider(self, column: np.ndarray) -> Rows:
        return Rows(self.hits, self.scale, np.column_stack([self.dense, column]))


def fit_logistic(x: Rows, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by accelerated gradient steps; the
    last weight is the bias. Needs no random numbers."""
    n, d = len(y), len(x.scale) + x.dense.shape[1]
    v = np.ones(d + 1)
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = x.back(x.times(v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (0.25 * top / n + RIDGE)
    w = u = np.zeros(d + 1)
    ridge = np.full(d + 1, RIDGE)
    ridge[-1] = 0
    for k in range(ROUNDS):
        new = u - step * (x.back(sigmoid(x.times(u)) - y) / n + ridge * u)
        u = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass(frozen=True)
class Chain:
    """A fitted chain: scaled features, one weight vector per category, and
    what moves a category's log odds from the sample's share to the table's."""

    categories: tuple[str, ...]
    index: dict[str, int]
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    shift: tuple[float, ...]

    def scores(self, hits: Sequence[np.ndarray]) -> np.ndarray:
        """Probabilities of each row (indices of its features) and category."""
        out = np.zeros((len(hits), len(self.categories)), np.float64)
        for k, w in enumerate(self.weights):
            d = len(self.scale)
            scaled = (w[:d] * self.scale).astype(np.float64)
            z = np.array([scaled[h].sum() for h in hits], np.float64) + float(w[-1])
            if k:
                z += out[:, :k] @ w[d : d + k].astype(np.float64)
            out[:, k] = sigmoid(z + self.shift[k])
        return out


def chosen_features(held: DataFrame, ys: Sequence[str], most: int) -> tuple[dict[str, int], np.ndarray]:
    """The features that tell most about any category, with their scale: the
    smoothed log ratio of their shares among rows with and without it. Ties go
    by the feature's name. ``held`` has an array of features per row."""
    side = {f"{y}_{v}": F.count_if(F.col(y) == v) for y in ys for v in (0, 1)}
    totals = held.agg(*(c.alias(n) for n, c in side.items())).first()
    counts = held.select(*ys, F.explode("held").alias("f")).groupBy("f").agg(F.count("*").alias("rows"), *(c.alias(n) for n, c in side.items()))
    gains = []
    for y in ys:
        without, having = ((F.col(f"{y}_{v}") + 0.5) / (totals[f"{y}_{v}"] + 1) for v in (0, 1))
        ratio = F.abs(F.log(having / without))
        gains.append(F.struct((ratio * F.abs(having - without)).alias("gain"), ratio.alias("ratio")))
    best = counts.where(F.col("rows") >= LEAST_ROWS).select("f", F.array_max(F.array(*gains)).alias("best")).where("best.gain > 0")
    top = best.orderBy(F.desc("best.gain"), "f").limit(most).collect()
    return {r.f: k for k, r in enumerate(top)}, np.minimum([r.best.ratio for r in top], 6)


def fit_chain(hits: Sequence[np.ndarray], y: np.ndarray, categories: Sequence[str], index: dict[str, int], scale: np.ndarray, shares: Sequence[float]) -> Chain:
    """Fit on rows of indices of features; ``y`` has a column of 0, 1 or nan per
    category, ``shares`` their shares among all labelled rows. A category of
    one value gets a model without weights that gives its share."""
    x = Rows(hits, scale)
    weights, shift = [], []
    for k in range(y.shape[1]):
        d = len(scale) + k
        known = np.flatnonzero(~np.isnan(y[:, k]))
        share, mine = min(max(shares[k], 1e-4), 1 - 1e-4), y[known, k].mean() if len(known) else 0.0
        if not 0 < mine < 1:
            w, move = np.zeros(d + 1), float(np.log(share / (1 - share)))
        else:
            w, move = fit_logistic(x.part(known), y[known, k]), float(np.log(share / (1 - share)) - np.log(mine / (1 - mine)))
        p = sigmoid(x.times(w) + move)
        for fold in range(FOLDS if 0 < mine < 1 and k + 1 < y.shape[1] else 0):  # nothing sees the last one's
            out, rest = known[known % FOLDS == fold], known[known % FOLDS != fold]
            if len(rest) and 0 < y[rest, k].mean() < 1:
                p[out] = sigmoid(x.part(out).times(fit_logistic(x.part(rest), y[rest, k])) + move)
        x = x.wider(p)
        weights.append(w)
        shift.append(move)
    return Chain(tuple(categories), index, scale, tuple(weights), tuple(shift))


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    features: int = FEATURES,
) -> Chain:
    """Fit the chain on a sample of labelled documents: at most ``positives``
    rows with the last category and ``negatives`` without it.

    Labels without a document, documents without labels and null labels take
    no part; of repeated labels of an id the largest counts, of repeated rows
    of an id the one with the smallest text (null first). Whole texts count,
    however long; what reaches the driver is the chosen features and, per
    sampled row, their indices. Empty
    tables give a chain without weights."""
    small_batches(docs.sparkSession)
    names = list(categories)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), *(c.cast("double").alias(f"y{k}") for k, c in enumerate(categories.values())))
    known = known.where("id IS NOT NULL").groupBy("id").agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))))
    shares = known.agg(*(F.avg(f"y{k}") for k in range(len(names)))).first()
    last = F.col(f"y{len(names) - 1}")
    pick = lambda value, n: known.where(last == value).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = F.broadcast(pick(1, positives).unionByName(pick(0, negatives)))  # bounded by the two parameters
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(sample, "id")

    @F.arrow_udf("array<string>")
    def features_of(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({f for w in words_of(t) for f in forms(w)}) for t in texts.to_pylist()], pa.list_(pa.string()))

    ys = [f"y{k}" for k in range(len(names))]
    held = rows.groupBy("id", *ys).agg(F.min("text").alias("text")).withColumn("held", features_of("text")).drop("text")
    held = stored(held, "toxicity-sample")
    index, scale = chosen_features(held, ys, features)
    chosen = docs.sparkSession.createDataFrame(list(index.items()), "f string, k int")
    at = held.select("id", F.explode("held").alias("f")).join(F.broadcast(chosen), "f").groupBy("id").agg(F.array_sort(F.collect_list("k")).alias("k"))
    got = held.drop("held").join(at, "id", "left").orderBy("id").toArrow()  # one row of the sample each
    listed = got["k"].combine_chunks()
    sizes = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    hits = np.split(listed.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(sizes)[:-1]) if len(got) else []
    y = np.column_stack([got[c].to_numpy() for c in ys]).astype(np.float64)
    return fit_chain(hits, y, names, index, scale, [s or 0.0 for s in shares])


def score(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability per category and the decision on the last
    one in a column of its name. Null, empty and wordless texts are scored as
    texts without features; whole texts count however long; repeated rows are
    scored each. A column of ``docs`` with the name of an added one is left
    out, all others stay whatever their names."""
    names = [*(f"{prefix}{n}" for n in chain.categories), chain.categories[-1]]
    rows = _scored(docs, chain, text_col)
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in names]
    p = [F.col("p")[k].alias(n) for k, n in enumerate(names[:-1])]
    return rows.select(*own, *p, (F.col("p")[len(p) - 1] >= THRESHOLD).alias(names[-1]))


def reject(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they were, that the chain does not reject."""
    return original(_scored(docs, chain, text_col).where(F.col("p")[len(chain.categories) - 1] < THRESHOLD), docs)


def _scored(docs: DataFrame, chain: Chain, text_col: str) -> DataFrame:
    """``docs`` with columns named by position, and the probabilities ``p``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(chain)
    memo: dict[str, tuple[int, ...]] = {}

    @F.arrow_udf("array<double>")
    def probabilities(texts: pa.Array) -> pa.Array:
        c = shared.value
        index, hits = c.index, []
        for text in texts.to_pylist():
            found: set[int] = set()
            for w in words_of(text):
                have = memo.get(w)
                if have is None:
                    if len(memo) > CACHE_WORDS:
                        memo.clear()
                    have = tuple(k for f in forms(w) if (k := index.get(f)) is not None)
                    if len(w) <= 40:
                        memo[w] = have
                if have:
                    found.update(have)
            hits.append(np.array(sorted(found), np.int64))
        return pa.array(list(c.scores(hits)), pa.list_(pa.float64()))

    rows = positional(docs)
    return rows.withColumn("p", probabilities(F.col(rows.columns[docs.columns.index(text_col)])))


def production_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """The judgements that the labels table has: poor quality, then toxicity."""
    return train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
