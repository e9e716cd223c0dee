"""Deterministic samples: every rank is a digest of a namespaced key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def rank_key(namespace: str, key: Column) -> Column:
    return F.sha2(F.concat_ws("\x01", F.lit(namespace), key.cast("string")), 256)


def hash_sample(df: DataFrame, key: str, namespace: str, n: int) -> DataFrame:
    """The n rows of lowest rank: a top-k, no total sort."""
    return df.orderBy(rank_key(namespace, F.col(key)), key).limit(n)


def top_per_stratum(df: DataFrame, strata: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = W.Window.partitionBy(*strata).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def quotas(counts: DataFrame, strata: Sequence[str], n: int) -> DataFrame:
    """Largest remainders over (strata, n) counts; ties by stratum. One row per
    stratum, so a single ordered window over them is small."""
    everything = W.Window.partitionBy()
    share = F.lit(float(n)) * F.col("n") / F.sum("n").over(everything)
    t = counts.withColumn("q", share).withColumn("b", F.floor("q"))
    k = F.row_number().over(W.Window.orderBy(F.desc(F.col("q") - F.col("b")), *strata))
    t = t.withColumns({"k": k, "rest": F.lit(n) - F.sum("b").over(everything)})
    return t.select(*strata, (F.col("b") + F.when(F.col("k") <= F.col("rest"), 1).otherwise(0)).cast("long").alias("quota"))


def quota_sample(df: DataFrame, strata: Sequence[str], key: str, namespace: str, n: int) -> DataFrame:
    q = quotas(df.groupBy(*strata).agg(F.count("*").alias("n")), strata, n)
    w = W.Window.partitionBy(*strata).orderBy(rank_key(namespace, F.col(key)), key)
    return df.withColumn("__k", F.row_number().over(w)).join(F.broadcast(q), list(strata)).where("__k <= quota").drop("__k", "quota")


def equal_quotas(sizes: dict[str, int], n: int) -> dict[str, int]:
    """Water filling: as even as the sizes allow, ties to the smaller name."""
    out, left = {}, min(n, sum(sizes.values()))
    order = sorted(sizes, key=lambda s: (sizes[s], s))
    for i, s in enumerate(order):
        share, extra = divmod(left, len(order) - i)
        if sizes[s] > share:  # nobody from here on is smaller than the share
            rest = sorted(order[i:])
            return out | {r: share + (k < extra) for k, r in enumerate(rest)}
        out[s] = sizes[s]
        left -= sizes[s]
    return out


def seeded_order(df: DataFrame, key: str, seed: str) -> DataFrame:
    """``place`` of each row in a seeded order, gapless from 0, by a bucket of
    the leading digest digits and the rank within it: no single-task sort."""
    r = df.withColumn("__r", rank_key(seed, F.col(key))).withColumn("__b", F.substring("__r", 1, 3))
    before = W.Window.orderBy("__b").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = r.groupBy("__b").agg(F.count("*").alias("__n"))  # at most 4096 rows
    starts = starts.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    inner = F.row_number().over(W.Window.partitionBy("__b").orderBy("__r", key)) - 1
    return r.withColumn("__i", inner).join(F.broadcast(starts), "__b").withColumn("place", F.col("__s") + F.col("__i")).drop("__r", "__b", "__s", "__i")


def whole_groups(counts: Sequence[tuple[str, int]], n: int) -> list[str]:
    """Whole groups, in the order given, while they fit the rows left."""
    out = []
    for name, rows in counts:
        if rows <= n:
            out.append(name)
            n -= rows
    return out


def band_targets(capacities: dict[str, int], total: int) -> dict[str, int]:
    """Rows to take from each band: even shares in the bands' order, the odd
    rows to the first, until ``total`` is reached; full bands pass theirs on."""
    if total < 1 or min(capacities.values(), default=0) < 0 or sum(capacities.values()) < total:
        raise ValueError("the bands cannot give so many rows")
    taken, left = dict.fromkeys(capacities, 0), total
    while left:
        room = [b for b in capacities if taken[b] < capacities[b]]
        share, odd = divmod(left, len(room))
        for i, b in enumerate(room):
            more = min(capacities[b] - taken[b], share + (i < odd))
            taken[b], left = taken[b] + more, left - more
    return taken
