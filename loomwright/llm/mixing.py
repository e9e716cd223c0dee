"""Mixing sources to target weights by a hypergeometric splitting tree.

Documents of a source fall into 4,096 blocks by a hash of their id. Per source
an exact quota of block draws is fixed: whole passes over the source, then
permuted blocks until the target is met. The vector of quotas is split
recursively between the halves of the output shards by multivariate
hypergeometric draws; each leaf then takes its quota as disjoint runs of the
permuted blocks, and its rows are shuffled locally.

Sources stay in tables however many there are: targets come by rounds of one
aggregation, draws are made in groups of sources, the tree splits the groups'
quotas (``GROUPS`` at most, which is all that meets on the driver), and each
group's shard quotas are split between its sources by the same draws. A plan
of at most ``PLAN_ROWS`` rows is broadcast, so documents are mixed without any
shuffle; a larger one is joined by (source, block).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomwright.llm.common import original, positional, stored, word_count

#: Blocks of a source, groups of sources at most, rows of a plan that is broadcast.
BLOCKS, GROUPS, PLAN_ROWS = 4096, 1 << 14, 1 << 18
SHARDS, SEED = 16, 20177


@dataclass(frozen=True)
class MixSpec:
    """Weights repeat over the sources in code-point order, null last."""

    weights: Sequence[float] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    shards: int = SHARDS
    seed: int = SEED


def targets(sizes: Sequence[int], spec: MixSpec) -> list[float]:
    """Shares of ``share`` times all sizes by weight; what exceeds ``most``
    times its source's size is dealt again by weight until nothing does."""
    weights = [float(spec.weights[i % len(spec.weights)]) for i in range(len(sizes))]
    out, left = [0.0] * len(sizes), spec.share * sum(sizes)
    free = set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > spec.most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = spec.most * sizes[i]
        left -= sum(out[i] for i in over)
        free -= over
    return out


def chosen_blocks(words: np.ndarray, want: float, order: np.ndarray) -> np.ndarray:
    """Blocks along ``order`` whose words come nearest to ``want``: a prefix,
    then every later block that still fits, then one more if that is nearer."""
    sums = np.cumsum(words[order])
    n = int(np.searchsorted(sums, want, "right"))
    taken, rest = list(order[:n]), []
    gap = want - (sums[n - 1] if n else 0)
    for b in order[n:]:
        if 0 < words[b] <= gap:
            taken.append(b)
            gap -= words[b]
        else:
            rest.append(b)
    if rest:
        last = min(rest, key=lambda b: (abs(gap - words[b]), b))
        if abs(gap - words[last]) < gap:
            taken.append(last)
    return np.array(taken, np.int64)


def split_tree(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of each shard: a row each, columns sum to ``quota`` exactly."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    part = rng.multivariate_hypergeometric(quota, int(quota.sum()) * left // shards, method="marginals")
    return np.vstack([split_tree(part, left, rng), split_tree(quota - part, shards - left, rng)])


def ranked_sources(totals: DataFrame, spec: MixSpec) -> DataFrame:
    """Per source its size and weight: sources in code-point order, null last.
    Ranges of sources are sorted apart; only their counts meet."""
    sizes = totals.groupBy("source").agg(F.sum("words").alias("size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stored(sizes.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-sources")
    before, starts = 0, []
    for r in ranged.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
        starts.append((r.range, before))
        before += r.n
    starts = F.broadcast(totals.sparkSession.createDataFrame(starts, "range int, start long"))
    place = F.row_number().over(W.Window.partitionBy("range").orderBy(*order)) - 1
    weight = F.array(*(F.lit(float(w)) for w in spec.weights))[((F.col("start") + F.col("place")) % len(spec.weights)).cast("int")]
    return ranged.withColumn("place", place).join(starts, "range").select("source", "size", weight.alias("weight"))


def targeted(sources: DataFrame, spec: MixSpec) -> DataFrame:
    """``sources`` (source, size, weight) with their targets: shares of
    ``share`` times all sizes by weight; what exceeds ``most`` times its
    source's size is dealt again by weight until nothing does. A round is one
    aggregation that finds how much a unit of weight gets."""
    sources = stored(sources, "mix-weights")
    most = spec.most * F.col("size")
    total, unit = spec.share * float(sources.agg(F.sum("size")).first()[0] or 0), 0.0
    while True:
        over = unit * F.col("weight") > most
        left = sources.agg(F.sum(F.when(over, most)).alias("dealt"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        now = (total - (left.dealt or 0.0)) / left.free if left.free else unit
        if now <= unit * (1 + 1e-12):  # no source more is above
            break
        unit = now
    return sources.withColumn("target", F.least(F.lit(unit) * F.col("weight"), most))


def draws_of(name: str | None, ids: np.ndarray, words: np.ndarray, want: float, seed: int) -> np.ndarray:
    """The blocks that one source gives, in order: whole passes, then those
    that come nearest to the rest of its target."""
    rng = np.random.default_rng([seed, *(name or "").encode("utf-8", "surrogatepass"), name is None])
    size = int(words.sum())
    whole = int(want // size) if size else 0
    passes = [ids[rng.permutation(len(ids))] for _ in range(whole)]
    rest = want - whole * size
    extra = chosen_blocks(words, rest, rng.permutation(len(ids))) if rest > 0 else []
    return np.concatenate([*passes, ids[np.array(extra, np.int64)]]).astype(np.int64)


def planned(totals: DataFrame, spec: MixSpec) -> DataFrame:
    """The plan: source, block, size and target of the source, and the shards
    of the block's draws, from the words of each source's blocks."""
    goal = targeted(ranked_sources(totals, spec), spec)
    group = F.pmod(F.xxhash64("source", F.lit(spec.seed)), F.lit(GROUPS)).cast("int")
    goal = stored(goal.select(F.col("source").alias("name"), "size", "target", group.alias("group")), "mix-targets")
    on = F.col("source").eqNullSafe(F.col("name"))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, own in rows.groupby("source", dropna=False, sort=False):
            name = None if pd.isna(name) else name
            own = own.sort_values("block")
            got = draws_of(name, own.block.to_numpy(np.int64), own.words.to_numpy(np.int64), float(own.target.iloc[0]), spec.seed)
            out.append((int(own.group.iloc[0]), name, int(own["size"].iloc[0]), float(own.target.iloc[0]), own.block.tolist(), got.tolist()))
        return pd.DataFrame(out, columns=["group", "source", "size", "target", "blocks", "draws"]).sort_values("source", na_position="last")

    kinds = "group int, source string, size long, target double, blocks array<int>, draws array<int>"
    drawn = stored(totals.join(goal, on).drop("name").groupBy("group").applyInPandas(draw, kinds), "mix-draws")
    quotas = sorted((r.group, r.n) for r in drawn.groupBy("group").agg(F.sum(F.size("draws")).alias("n")).collect())
    split = split_tree(np.array([n for _, n in quotas], np.int64), spec.shards, np.random.default_rng(spec.seed)) if quotas else np.empty((spec.shards, 0))
    dealt = totals.sparkSession.createDataFrame([(g, split[:, k].tolist()) for k, (g, _) in enumerate(quotas)], "group int, quotas array<long>")

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last")
        left = np.array([len(d) for d in rows.draws], np.int64)
        rng = np.random.default_rng([spec.seed, int(rows.group.iloc[0])])
        shares = []
        for n in rows.quotas.iloc[0]:
            shares.append(rng.multivariate_hypergeometric(left, int(n), method="marginals") if len(left) > 1 else np.array([n], np.int64))
            left = left - shares[-1]
        out = []
        for k, r in enumerate(rows.itertuples(index=False)):
            own: dict[int, list[int]] = {int(b): [] for b in r.blocks}
            for b, s in zip(r.draws, np.repeat(np.arange(spec.shards), [s[k] for s in shares]).tolist(), strict=True):
                own[int(b)].append(s)
            out += [(r.source, b, r.size, r.target, s) for b, s in own.items()]
        return pd.DataFrame(out, columns=["source", "block", "size", "target", "shards"])

    kinds = "source string, block int, size long, target double, shards array<int>"
    return stored(drawn.join(F.broadcast(dealt), "group").groupBy("group").applyInPandas(deal, kinds), "mix-plan")


def _drawn(docs: DataFrame, spec: MixSpec, id_col: str, source_col: str, size: Callable[[Column], Column] | None, text_col: str) -> DataFrame:
    """``docs`` with columns named by position, the id, its size, and the plan."""
    rows = positional(docs)
    at = dict(zip(docs.columns, rows.columns, strict=True))
    block = F.pmod(F.xxhash64(F.col(at[id_col]), F.lit(spec.seed)), F.lit(BLOCKS)).cast("int")
    rows = rows.withColumns({"doc_id": F.col(at[id_col]), "of": F.col(at[source_col]), "words": (size or word_count)(F.col(at[text_col])), "at": block})
    totals = rows.groupBy(F.col("of").alias("source"), F.col("at").alias("block")).agg(F.sum("words").alias("words"))
    plan = planned(stored(totals, "mix-blocks"), spec)
    if plan.count() <= PLAN_ROWS:
        plan = F.broadcast(plan)
    return rows.join(plan, F.col("of").eqNullSafe(F.col("source")) & (F.col("at") == F.col("block")))


def assign(
    docs: DataFrame,
    spec: MixSpec = MixSpec(),
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Callable[[Column], Column] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with size, source_size, target and the shards of its draws.

    ``mix_shards`` holds one shard per draw, so its length is how often the
    mix takes the document: never more than ``most``, rounded up. Null and
    empty texts have size 0; null sources form a source of their own, behind
    all others. Rows that repeat an id are drawn alike. An empty table gives no
    rows. A column of ``docs`` with the name of an added one (mix_size,
    mix_source_size, mix_target, mix_shards) is left out, all others stay
    whatever their names. Reruns give the same draws."""
    added = {"mix_size": "words", "mix_source_size": "size", "mix_target": "target", "mix_shards": "shards"}
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in added]
    return _drawn(docs, spec, id_col, source_col, size, text_col).select(*own, *(F.col(c).alias(n) for n, c in added.items()))


def mixed(
    docs: DataFrame,
    spec: MixSpec = MixSpec(),
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Callable[[Column], Column] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """The mix itself: the columns of ``docs``, whatever their names, one row
    per draw, grouped by shard and shuffled within it. Odd rows as in
    :func:`assign`."""
    rows = _drawn(docs, spec, id_col, source_col, size, text_col)
    drawn = rows.select(*(f"c{i}" for i in range(len(docs.columns))), "doc_id", F.posexplode("shards").alias("copy", "shard"))
    place = F.xxhash64(F.lit(spec.seed), F.col("doc_id"), F.col("copy"))
    spread = F.pmod(place, F.lit(64))  # a shard's rows in many tasks, in the order of their place
    return original(drawn.repartition("shard", spread).sortWithinPartitions("shard", place), docs)
