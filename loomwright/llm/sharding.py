"""Sharding indivisible groups by Karmarkar-Karp differencing.

Groups are documents of equal text. They fall into cells by their digest; in
each cell differencing packs the groups into bins, in parallel. While there
are more than ``ITEMS`` bins they are packed again like groups. The bins that
are left, and on their own the few groups with a notable part of all bytes or
rows, are then differenced into the shards. Every round holds a bounded number
of items per task: a cell some thousands, the driver ``ITEMS`` bins and at
most twice ``HEAVY`` heavy groups.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from loomwright.llm.common import stored

#: Groups in a cell, bins of all cells, groups of more than this part of all bytes or rows stand alone.
CELL_GROUPS, ITEMS, HEAVY = 8192, 1 << 16, 4096
SLOT_ROWS = 1 << 16


def difference(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each item. Partial partitions start as single items; the
    two with the largest spread are combined, largest part against smallest,
    until one is left. Ties go by position, so reruns agree."""
    n = len(sizes)
    labels = np.zeros(n, np.int64)
    if n == 0 or parts == 1:
        return labels
    value = {}
    made: list[tuple[int, int, np.ndarray]] = []
    heap = []
    for i, s in enumerate(sizes.tolist()):
        value[i] = np.zeros(parts, np.int64)
        value[i][0] = s
        heap.append((-s, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = value.pop(a) + value.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        made.append((a, b, order.astype(np.int16)))
        value[n + len(made) - 1] = both
        heapq.heappush(heap, (-int(both[0]), n + len(made) - 1))
    at = {heap[0][1]: np.arange(parts)}
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        label = np.empty(parts, np.int64)
        label[order] = at.pop(n + k)
        for child, its in ((a, label), (b, label[::-1])):
            if child < n:
                labels[child] = its[0]
            else:
                at[child] = its
    return labels


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law 'bytes', shard,
    slot (gapless from 0 in each shard) and grown_shard (null under this law).

    Equal texts share a shard; null counts as the empty text, of size 8. Rows
    that repeat an id are separate rows with slots of their own. An empty table
    gives no rows; extra columns are ignored."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    groups = stored(slim.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    total = groups.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    weighty = (F.col("bytes") > max(1, (total.bytes or 0) // HEAVY)) | (F.col("rows") > max(1, (total.rows or 0) // HEAVY))
    heavy, light = groups.where(weighty), groups.where(~weighty)

    def packer(bins: int):
        def pack(cell: pd.DataFrame) -> pd.DataFrame:
            cell = cell.sort_values("item")
            return cell.assign(bin=cell.cell.astype(np.int64) * bins + difference(cell.bytes.to_numpy(np.int64), bins))

        return pack

    # Levels of packing: each maps its items to bins, which are the next level's items.
    items, n, levels = light.select(F.col("digest").alias("item"), "bytes"), total.n, []
    while not levels or n > ITEMS:
        cells = max(1, -(-n // CELL_GROUPS))
        bins = max(4, min(256, ITEMS // cells))
        dealt = items.withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(cells)).cast("long"))
        kind = dict(items.dtypes)["item"]
        levels.append(stored(dealt.groupBy("cell").applyInPandas(packer(bins), f"item {kind}, bytes long, cell long, bin long"), "shard-bins"))
        items = stored(levels[-1].groupBy(F.col("bin").alias("item")).agg(F.sum("bytes").alias("bytes")), "shard-items")
        n = items.count()
    # Bounded: HEAVY groups have over 1/HEAVY of all bytes each, as many of all rows, and ITEMS bins are left.
    alone = sorted((bytes(r.digest), r.bytes) for r in heavy.collect())
    filled = sorted((r.item, r.bytes) for r in items.collect())
    where = difference(np.array([b for _, b in alone] + [b for _, b in filled], np.int64), shards).tolist()
    alone_at = spark.createDataFrame(
        [(d, s) for (d, _), s in zip(alone, where)],
        T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shard", T.IntegerType())]),
    )
    at = F.broadcast(spark.createDataFrame([(b, s) for (b, _), s in zip(filled, where[len(alone) :])], "bin long, shard int"))
    for level in reversed(levels):
        by_item = level.join(at, "bin").select("item", "shard")
        at = by_item.withColumnRenamed("item", "bin")
    by_digest = by_item.withColumnRenamed("item", "digest")
    hot = slim.join(F.broadcast(alone_at), "digest")
    cold = slim.join(F.broadcast(alone_at), "digest", "left_anti").join(by_digest, "digest")
    lanes = max(1, min(SLOT_ROWS, (total.n or 0) // SLOT_ROWS))
    lane = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(lanes * 16)).cast("int")
    placed = stored(hot.unionByName(cold).select("doc_id", "size", "text_crc32", "shard", lane.alias("lane")), "shard-placed")
    counts = placed.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = W.Window.partitionBy("shard").orderBy("lane").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("rank", rank).join(starts, ["shard", "lane"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
