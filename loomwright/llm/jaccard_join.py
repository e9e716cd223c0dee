"""N-gram Jaccard self-join by adaptive multi-match prefixes.

A document is its set of distinct k-word shingles. Under one global order of
shingles, rare ones first, two sets of sizes n and m that are similar enough
share at least ``l`` of their first ``n - T + l`` (``m - T + l``) shingles,
where T is the overlap they need. Each document lengthens its prefix, raising
``l``, as long as the estimated cost of its candidates falls by more than the
longer prefix adds; a pair must then share min(l, l') prefix shingles before
it is verified on the whole sets.

The order comes from document frequencies counted over all documents. Chunks
of documents deal their distinct shingles to hash ranges as blocks of 32-bit
keys, the ranges count, and each block gets the binary logarithms of its
frequencies back. Shingles of one document only come first in every order and
are never posted, so documents meet over what others hold as well.

Links are found without listing pairs within a group:

1. documents of equal sets form a class, known by its smallest id;
2. rounds of *pivots*: of each prefix shingle's holders, one in its commonest
   component is the pivot of those in other components (at first the holder
   that has the shingle earliest: the least edited of a family of copies);
   each class is verified against the nearest pivot by parity sketch, and
   links contract components, until the pairs left are no more than postings
   or a round hardly lessens them;
3. only pairs that those links leave in different components become
   candidates of the full multi-match join, in which of each shingle's holders
   those outside its commonest component meet the others. The sketch bounds
   the difference of two sets from below, so it drops no link.

Every pair that is similar enough is thus either inside a component already or
verified, so components are exact. Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import discard, small_batches, stored
from loomwright.llm.components import components

#: Bytes of text in a chunk, and in a hash range's share: as small as the first,
#: beyond PARTS of them as large as the second.
CHUNK_BYTES, MOST_BYTES, PARTS = 8 << 20, 64 << 20, 2048
#: Longest multi-match; what a prefix shingle costs, and what each shingle of a
#: candidate does: its sets are fetched, moved and intersected.
MOST_MATCHES, ROW_COST, VERIFY_COST = 8, 1.0, 2.0
#: Words of 64 bits in a parity sketch; another round of pivots must leave less than this part of the pairs.
SKETCH, PROGRESS = 4, 0.8
#: So many ids at most are broadcast.
FEW = 1 << 20
#: Salts of one class of equal sets on the way back to its documents.
SALTS = 32

PROFILE = "doc_id long, n int, sig binary, l int, pos array<int>, tokens array<long>, sketch array<long>, members array<long>"
TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
POST = ["token", "rep", "n", "l", "pos", *(f"s{i}" for i in range(SKETCH))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles, A-Z in lower case;
    with fewer words the whole sequence is one; without words there are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - k + 1
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = _mix(acc + h[j : j + n])
    return np.unique(acc)


def needed(n: int, percent: int) -> int:
    """The overlap that a set of n shingles has with any set similar enough."""
    return (percent * n + 99) // 100


def prefix(s: np.ndarray, level: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """The multi-match number, and where in ``s`` its prefix is, rarest first.
    ``level`` holds the binary logarithms of the shingles' frequencies."""
    n = len(s)
    least = n - needed(n, percent) + 1
    most = min(MOST_MATCHES, needed(n, percent))
    if least + most - 1 < n // 2:  # only the first few are needed in order
        near = np.argpartition(level, least + most)
        near = np.nonzero(level <= level[near[least + most]])[0]
    else:
        near = np.arange(n)
    order = near[np.lexsort((s[near], level[near]))][: least + most - 1]
    found = np.cumsum(np.exp2(level[order]) - 1)
    l = np.arange(1, most + 1)
    hits = found[np.minimum(least + l - 2, len(order) - 1)]
    cost = ROW_COST * (hits + least + l) + VERIFY_COST * n * hits / l**2
    best = int(np.argmin(cost)) + 1
    return best, order[: least + best - 1]


def parity(s: np.ndarray) -> np.ndarray:
    """The parity sketch: bit b tells whether an odd number of shingles fall on
    it. Sets that differ in d shingles differ in d bits at most."""
    odd = np.bincount((s >> np.uint64(24)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _dealt(u: np.ndarray, parts: int) -> np.ndarray:
    """Where in the sorted shingles ``u`` each of the hash ranges begins; and the end."""
    of = ((u >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(parts + 1, dtype=np.uint64))


def _frequencies(docs: DataFrame, k: int, parts: int) -> DataFrame:
    """Per (chunk, range) which of the block's shingles several documents hold,
    as bits, and the binary logarithms of how many do."""

    def deal(rows: pa.Table) -> pa.Table:
        sets = [shingles(t, k) for t in rows["text"].to_pylist()]
        u, n = np.unique(np.concatenate(sets), return_counts=True)
        cuts, out = _dealt(u, parts), []
        low = u.astype(np.uint32)
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[r], cuts[r + 1])
            more = np.flatnonzero(n[own] > 1).astype(np.uint32)
            out.append((rows["chunk"][0].as_py(), r, low[own].tobytes(), more.tobytes(), n[own][more].astype(np.uint32).tobytes()))
        cols = list(zip(*out)) if out else [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["chunk", "part", "keys", "more", "counts"])

    def tally(rows: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(b, np.uint32) for b in rows["keys"].to_pylist()]
        ends = np.cumsum([len(b) for b in blocks])
        held = np.ones(ends[-1], np.float64)
        for end, block, more, n in zip(ends.tolist(), blocks, rows["more"].to_pylist(), rows["counts"].to_pylist(), strict=True):
            held[end - len(block) + np.frombuffer(more, np.uint32).astype(np.int64)] = np.frombuffer(n, np.uint32)
        _, at = np.unique(np.concatenate(blocks), return_inverse=True)
        level = np.floor(np.log2(np.bincount(at, held)))[at].astype(np.uint8)
        parts_of = np.split(level, ends[:-1])
        bits = [np.packbits(x > 0).tobytes() for x in parts_of]
        return pa.Table.from_arrays(
            [rows["chunk"], rows["part"], pa.array(bits, pa.binary()), pa.array([x[x > 0].tobytes() for x in parts_of], pa.binary())],
            ["chunk", "part", "bits", "levels"],
        )

    blocks = docs.select("chunk", "text").groupBy("chunk").applyInArrow(deal, "chunk int, part int, keys binary, more binary, counts binary")
    return blocks.groupBy("part").applyInArrow(tally, "chunk int, part int, bits binary, levels binary")


def _profile(docs: DataFrame, frequencies: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """Per document its size and signature; for one of each chunk's equal sets
    also the prefix shingles that other documents hold, with their places, the
    sketch and the whole set, if any of its prefix is shared."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        ids = rows["doc_id"].to_pylist()
        sets = [shingles(t, k) for t in rows["text"].to_pylist()]
        ends = np.cumsum([len(s) for s in sets])
        u, at = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_inverse=True)
        cuts, level = _dealt(u, parts), np.zeros(len(u), np.int64)
        for r, bits, levels in zip(answers["part"].to_pylist(), answers["bits"].to_pylist(), answers["levels"].to_pylist(), strict=True):
            a, b = cuts[r], cuts[r + 1]
            level[a + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a))] = np.frombuffer(levels, np.uint8)
        signs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        first: dict[tuple, int] = {}
        for i, own in enumerate(ids):
            if own is not None and (j := first.setdefault((len(sets[i]), signs[i]), i)) != i and own < ids[j]:
                first[len(sets[i]), signs[i]] = i
        out = []
        for i, (own, s, sig) in enumerate(zip(ids, sets, signs, strict=True)):
            more = (None,) * 5
            if len(s) and first.get((len(s), sig)) == i:
                mine = level[at[ends[i] - len(s) : ends[i]]]
                l, where = prefix(s, mine, percent)
                pos = np.flatnonzero(mine[where] > 0).astype(np.int32)
                if len(pos):
                    more = (l, pos, s[where[pos]].view(np.int64), parity(s), s.view(np.int64))
            out.append((own, len(s), sig, *more))
        cols = list(zip(*out)) if out else [()] * len(TYPES)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)], PROFILE.replace(",", "").split()[::2])

    return docs.groupBy("chunk").cogroup(frequencies.groupBy("chunk")).applyInArrow(run, PROFILE)


def _apart() -> Column:
    """The least that the sets of a posting and of another (columns with 1) differ in."""
    return sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"s{i}1"))) for i in range(1, SKETCH)), F.bit_count(F.col("s0").bitwiseXOR(F.col("s01"))))


def _within(percent: int) -> Column:
    """Of a shingle that two sets (n, pos, l and n1, pos1, l1) share: whether
    their sizes allow the similarity, the shingle lies within the prefixes that
    this pair's own overlap asks for, what can be common before and behind it
    is enough for that overlap, and so is what the sketches leave."""
    n, m = F.col("n"), F.col("n1")
    need = F.floor((percent * (n + m) + 99 + percent) / (100 + percent))
    l = F.least("l", "l1")
    sizes = (100 * n >= percent * m) & (100 * m >= percent * n)
    p, q = F.col("pos"), F.col("pos1")
    enough = F.least(p, q) + F.least(n - p, m - q) >= need
    return sizes & (p < n - need + l) & (q < m - need + l) & enough & (_apart() <= n + m - 2 * need)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Only sets of their
    members move: few members are broadcast to find them, many are joined."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    if members.count() <= FEW:
        members = F.broadcast(members)
    sets = sets.join(members, "rep", "left_semi")
    left = sets.select(F.col("rep").alias("a"), F.col("members").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("members").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    rows = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return rows.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _contracted(known: DataFrame, links: DataFrame, scratch: list[str]) -> DataFrame:
    """``known`` (rep, c) once the components that ``links`` (a, b) join are one."""
    of = lambda side: known.select(F.col("rep").alias(side), F.col("c").alias(f"c_{side}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    roots = components(edges, scratch).withColumnRenamed("node", "c")
    return stored(known.join(roots, "c", "left").select("rep", F.coalesce("component", "c").alias("c")), "jaccard-components", scratch)


def similar_classes(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest id that links reach; two documents link
    when 100 * intersection >= percent * union. Null, empty and blank texts
    have no shingles and are linked with nothing. Rows that repeat an id are
    kept apart only in the output. An empty table gives no rows; extra columns
    are ignored. A null id stands for itself alone (component null)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch: list[str] = []
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // min(max(size // PARTS, CHUNK_BYTES), MOST_BYTES)))
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(parts)).cast("int"))
    frequencies = stored(_frequencies(chunked, k, parts), "jaccard-frequencies", scratch)
    profile = stored(_profile(chunked, frequencies, k, percent, parts), "jaccard-profile", scratch)
    slim = profile.select("doc_id", "n", "sig", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    live = slim.where("n > 0 AND doc_id IS NOT NULL")
    salted = live.groupBy("n", "sig", "salt").agg(F.min("doc_id").alias("low"))
    classes = salted.groupBy("n", "sig").agg(F.min("low").alias("rep"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    classes = stored(classes, "jaccard-classes", scratch)
    leads = profile.where("l IS NOT NULL")
    sets = leads.select(F.col("doc_id").alias("rep"), "members")
    own = leads.drop("members").join(classes.select("n", "sig", F.col("rep").alias("doc_id")), ["n", "sig", "doc_id"], "left_semi")
    words = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]
    posts = own.select(F.col("doc_id").alias("rep"), "n", "l", *words, F.explode(F.arrays_zip("pos", "tokens")).alias("t"))
    posts = stored(posts.withColumns({"pos": F.col("t.pos"), "token": F.col("t.tokens")}).select(POST), "jaccard-posts", scratch)
    total, left = posts.count(), float("inf")
    known = stored(posts.select("rep").distinct().withColumn("c", F.col("rep")), "jaccard-components", scratch)
    tested = stored(posts.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0), "jaccard-tested", scratch)
    for turn in count():
        home = posts.join(known, "rep")
        rank = F.struct(F.col("pos") if turn == 0 else F.lit(0), F.xxhash64("rep", F.lit(turn)))
        lead = F.struct(*(F.col(x).alias(f"{x}1") for x in POST[1:]))
        by_component = home.withColumn("rank", rank).groupBy("token", "c").agg(
            F.count("*").alias("m"), F.min_by(lead, "rank").alias("lead"), F.min("rank").alias("rank")
        )
        first = F.struct(-F.col("m"), "rank")
        tops = by_component.groupBy("token").agg(
            F.sum("m").alias("held"), F.max("m").alias("m"), F.min_by("lead", first).alias("lead"), F.min_by("c", first).alias("main")
        ).where("held > m")
        tops = stored(tops, "jaccard-pivots", scratch)
        before, left = left, tops.agg(F.sum((F.col("held") - F.col("m")) * F.col("held"))).first()[0] or 0
        if turn and (left <= total or left > PROGRESS * before):
            break
        met = home.join(tops.select("token", "main", "lead.*"), "token").where(F.col("c") != F.col("main")).where(_within(percent))
        votes = met.groupBy(F.col("rep").alias("a"), F.col("rep1").alias("b")).agg(F.count("*").alias("v"), F.min(_apart()).alias("d"))
        votes = votes.join(tested, ["a", "b"], "left_anti").groupBy("a").agg(F.min_by("b", F.struct("d", -F.col("v"), "b")).alias("b"))
        pairs = stored(votes, "jaccard-stars", scratch)
        links = stored(_verified(pairs, sets, percent), "jaccard-links", scratch)
        known = _contracted(known, links, scratch)
        tested = tested.unionByName(pairs)
    # Pairs across the components found so far.
    mixed = home.join(tops.select("token", "main"), "token")
    few = mixed.where("c <> main").select(*(F.col(x).alias(f"{x}1") for x in [*POST[1:], "c"]), "token")
    once = (F.col("c") == F.col("main")) | (F.col("rep") > F.col("rep1"))
    met = mixed.join(few, "token").where((F.col("c") != F.col("c1")) & once & _within(percent))
    hits = met.groupBy(F.least("rep", "rep1").alias("a"), F.greatest("rep", "rep1").alias("b"))
    pairs = hits.agg(F.count("*").alias("v"), F.min(F.least("l", "l1")).alias("l")).where("v >= l").select("a", "b")
    pairs = stored(pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "jaccard-pairs", scratch)
    known = _contracted(known, stored(_verified(pairs, sets, percent), "jaccard-links", scratch), scratch)
    salts_of = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("mask", s) == 1)
    named = classes.join(known, "rep", "left").select("n", "sig", F.coalesce("c", "rep").alias("component_id"), F.explode(salts_of).alias("salt"))
    out = slim.join(named, ["n", "sig", "salt"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
    result = stored(out, "jaccard-classes-of-documents")
    discard(spark, scratch)  # the result stands alone
    return result
