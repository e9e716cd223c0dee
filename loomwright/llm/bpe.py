"""Byte-level BPE by speculation and verification.

A text is cut into chunks (an optional space and a run of non-space, or white
space) whose encodings do not depend on their neighbours. For chunks that are
not cached:

* speculate: greedy longest match proposes tokens for each word;
* verify: a vectorised check tests every adjacent pair of proposed tokens of
  the batch. A sequence of tokens that each encode to themselves is the BPE
  encoding of its bytes exactly when no merge across any adjacent pair would
  have come before the merges that built the pair;
* repair: only words with a failing pair are merged exactly, pair by pair.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import small_batches

#: Unicode White_Space, as the pre-tokenizer's \s reads it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: The pre-tokenization pattern of this kind of vocabulary.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+")
CACHE_CHUNKS, CACHE_CHARS, LONG_WORD = 300_000, 48, 200
#: A batch is encoded in rounds of so many chunks; texts longer than a segment are cut.
ROUND_CHUNKS, SEGMENT_CHARS = 120_000, 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies:
    printable Latin-1 stands for itself, the rest is numbered from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    """Encoder and decoder of one vocabulary file; bounded caches only."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        # Own numbering: bytes 0 to 255, then merges by rank; out[own] is the vocabulary's id.
        own = {c: b for c, b in alphabet.items()}
        self.bytes_of = [bytes([b]) for b in range(256)]
        out = [vocab[c] for c, b in sorted(alphabet.items(), key=lambda x: x[1])]
        left, right, pairs = list(range(256)), list(range(256)), {}
        for merge in merges:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if (own[a], own[b]) in pairs:
                continue
            if a + b not in own:
                own[a + b] = len(self.bytes_of)
                self.bytes_of.append(raw(a + b))
                out.append(vocab[a + b])
                left.append(own[a])
                right.append(own[b])
            pairs[own[a], own[b]] = own[a + b]
        self.pairs, self.out = pairs, np.array(out, np.int32)
        self.packed = [int(i).to_bytes(4, "little") for i in out]
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.never = len(self.bytes_of)
        self._build_table(np.array([a << 32 | b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int64))
        ids = np.arange(256, len(left))
        sound = np.ones(len(left), bool)
        sound[256:] = self.stable(self.left[256:], self.right[256:], ids)
        while not np.array_equal(sound, now := sound & sound[self.left] & sound[self.right]):
            sound = now
        self.match = {t: i for i, t in enumerate(self.bytes_of) if sound[i]}
        self.trie = ahocorasick.Automaton()
        for t, i in self.match.items():
            self.trie.add_word(t.decode("latin-1"), i)
        self.trie.make_automaton()
        size = max([*out, *self.specials.values()]) + 1
        self.decoded = [b""] * size
        for i, t in zip(out, self.bytes_of, strict=True):
            self.decoded[i] = t
        for t, i in self.specials.items():
            self.decoded[i] = t.encode()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _build_table(self, codes: np.ndarray, joined: np.ndarray) -> None:
        """Pairs in an open-addressing table of four places or more for each."""
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(codes))))))
        self.codes, self.joined = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.never, np.int64)
        at, left = self._slot(codes), np.arange(len(codes))
        while len(left):
            _, first = np.unique(at[left], return_index=True)
            mine = left[first][self.codes[at[left[first]]] < 0]
            self.codes[at[mine]], self.joined[at[mine]] = codes[mine], joined[mine]
            left = left[self.codes[at[left]] != codes[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token, by rank, that each pair merges into; ``never`` for no merge."""
        codes = a << 32 | b
        at = self._slot(codes)
        have = self.codes[at]
        out = np.where(have == codes, self.joined[at], self.never)
        left = np.flatnonzero((have != codes) & (have >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            have = self.codes[at[left]]
            same = have == codes[left]
            out[left[same]] = self.joined[at[left[same]]]
            left = left[~same & (have >= 0)]
        return out

    def stable(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: whether no merge across the border comes
        before the merges that built the two (or before ``limit``).

        Both sides are unbuilt step by step, the later merge first; at each
        step the tokens that touch at the border are looked up as a pair."""
        n = len(a)
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(n, np.iinfo(np.int64).max) if limit is None else limit.astype(np.int64)
        good, at = np.ones(n, bool), np.arange(n)
        while len(at):
            made = self.join(a, b)
            bad = (made < limit) & (made < self.never)
            good[at[bad]] = False
            # The last-built side is undone; a byte cannot be, then the other side is.
            a_first = a > b
            can_a, can_b = a >= 256, b >= 256
            undo_a = np.where(a_first, can_a, can_a & ~can_b)
            undo_b = ~undo_a & can_b
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a = np.where(undo_a, self.right[a], a)
            b = np.where(undo_b, self.left[b], b)
            go = ~bad & (undo_a | undo_b)
            a, b, limit, at = a[go], b[go], limit[go], at[go]
        return good

    def guess(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over all words at once: tokens, and the index
        of each token's word. A character beyond the bytes parts the words, so
        that no match spans two."""
        line = "\u0100".join([w.decode("latin-1") for w in words])
        hits = np.array([x for hit in self.trie.iter_long(line) for x in hit], np.int64).reshape(-1, 2)
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
        return hits[:, 1], np.searchsorted(ends, hits[:, 0], "right")

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging, lowest rank first and leftmost among equals: a pair of
        every word in each round, all words at once. Very long words, which
        would take as many rounds, are merged apart."""
        out: list[list[int]] = [self._merged_long(w) if len(w) > LONG_WORD else [] for w in words]
        short = np.array([k for k, w in enumerate(words) if 0 < len(w) <= LONG_WORD], np.int64)
        if not len(short):
            return out
        token = np.frombuffer(b"".join([words[k] for k in short.tolist()]), np.uint8).astype(np.int64)
        of = np.repeat(short, [len(words[k]) for k in short.tolist()])
        rank = np.full(len(token), self.never, np.int64)
        inner = np.flatnonzero(of[:-1] == of[1:])
        rank[inner] = self.join(token[inner], token[inner + 1])
        while len(token):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            sizes = np.diff(np.append(starts, len(of)))
            low = np.minimum.reduceat(rank, starts)
            done = low == self.never
            if done.any():
                over = np.repeat(done, sizes)
                flat, ends = token[over].tolist(), np.cumsum(sizes[done]).tolist()
                for k, i, j in zip(of[starts[done]].tolist(), [0, *ends], ends):
                    out[k] = flat[i:j]
                token, of, rank = token[~over], of[~over], rank[~over]
                sizes, low = sizes[~done], low[~done]
                if not len(token):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, sizes))
            at = hits[np.concatenate([[True], of[hits[1:]] != of[hits[:-1]]])]
            token[at] = low
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one token less for each word before
            token, of, rank = token[keep], of[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                inside = i[i + 1 < len(of)]
                same = of[inside] == of[inside + 1]
                rank[i] = self.never
                rank[inside[same]] = self.join(token[inside[same]], token[inside[same] + 1])
        return out

    def _merged_long(self, word: bytes) -> list[int]:
        """The same by a heap, for words whose every scan would cost too much."""
        tokens, n, pairs = list(word), len(word), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (m := pairs.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, x, y = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != x or j >= n or tokens[j] != y:
                continue
            tokens[i], tokens[j], after[i] = m, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (k := pairs.get((m, tokens[after[j]]))) is not None:
                    heapq.heappush(heap, (k, i, m, tokens[after[j]]))
            if (p := before[i]) >= 0 and (k := pairs.get((tokens[p], m))) is not None:
                heapq.heappush(heap, (k, p, tokens[p], m))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Own numbers of the tokens of each word."""
        flat, word_at = self.guess(words)
        fine = np.ones(max(len(flat) - 1, 0), bool)
        inner = word_at[:-1] == word_at[1:]
        code, back = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        fine[inner] = self.stable(code >> 32, code & 0xFFFFFFFF)[back]
        tokens, ends = flat.tolist(), np.searchsorted(word_at, np.arange(len(words) + 1)).tolist()
        found = [tokens[i:j] for i, j in zip(ends, ends[1:])]
        failing = np.unique(word_at[:-1][~fine]).tolist()
        for k, tokens in zip(failing, self.merged([words[k] for k in failing]), strict=True):
            found[k] = tokens
        return found

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of new chunks. The words of a chunk are chunks themselves and
        may be known already, as those before a mark of punctuation mostly are."""
        young, old = self.young, self.old
        cut = {c: WORD.findall(c) for c in chunks if not (c.isalpha() or c[0] == " " and c[1:].isalpha())}
        words = (chunks.difference(cut)).union(*cut.values()) if cut else chunks
        ids = {w: young[w] if w in young else old[w] for w in words if w in young or w in old}
        new = list(words.difference(ids))
        ids.update(zip(new, self._ids([w.encode() for w in new]), strict=True))
        ids.update((c, b"".join([ids[w] for w in ws])) for c, ws in cut.items())
        return ids

    def _ids(self, words: list[bytes]) -> list[bytes]:
        out = self.packed
        return [b"".join([out[t] for t in tokens]) for tokens in self.encode_words(words)]

    def _parts(self, text: str) -> Iterator[str | int]:
        """Special tokens as ids and the texts between them, in segments that
        end before a single white space between two non-spaces."""
        at = 0
        for m in [*(self.special_at.finditer(text) if self.special_at else ()), None]:
            end = m.start() if m else len(text)
            while end - at > SEGMENT_CHARS:
                cut = re.compile(f"(?<=[^{SPACE}])[{SPACE}](?=[^{SPACE}])").search(text, at + SEGMENT_CHARS, end)
                if not cut:
                    break
                yield text[at : cut.start()]
                at = cut.start()
            if end > at:
                yield text[at:end]
            if m:
                yield self.specials[m[0]]
                at = m.end()

    def _round(self, parts: list[tuple[int, list[str] | int]], out: list[list[bytes]]) -> None:
        """Encode the gathered parts: look up, learn what is new in one go, join."""
        young, old = self.young, self.old
        new = {c for c in set().union(*(p for _, p in parts if not isinstance(p, int))) if c not in young}
        known = {c: old[c] for c in new if c in old}
        fresh = self._learn(new.difference(known))
        young.update(known)
        young.update(fresh)
        for k, p in parts:
            out[k].append(np.array([p], np.int32).tobytes() if isinstance(p, int) else b"".join(map(young.__getitem__, p)))
        for c in fresh:
            if len(c) > CACHE_CHARS:
                del young[c]
        if len(young) > CACHE_CHUNKS:
            self.old, self.young = young, {}

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[list[bytes]] = [[] for _ in texts]
        parts: list[tuple[int, list[str] | int]] = []
        held = 0
        for k, text in enumerate(texts):
            for part in self._parts(text or ""):
                parts.append((k, part if isinstance(part, int) else CHUNK.findall(part)))
                held += 1 if isinstance(part, int) else len(parts[-1][1])
                if held > ROUND_CHUNKS:
                    self._round(parts, out)
                    parts, held = [], 0
        self._round(parts, out)
        return [np.frombuffer(b"".join(x), np.int32) for x in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Unknown ids give nothing; bytes that are no UTF-8 give U+FFFD."""
        table = self.decoded
        if len(ids) and (int(ids.max()) >= len(table) or int(ids.min()) < 0):
            ids = ids[(ids >= 0) & (ids < len(table))]
        return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> SpeculativeBpe:
    """One per Python worker and file."""
    return SpeculativeBpe(path)


def _ids_array(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


def encoder(path: str):
    """An Arrow UDF: string to array<int>; null gives no ids."""

    @F.arrow_udf("array<int>")
    def encode_ids(texts: pa.Array) -> pa.Array:
        return _ids_array(tokenizer(path).encode_batch(texts.to_pylist()))

    return encode_ids


def decoder(path: str):
    """An Arrow UDF: array<int> to string; null gives the empty text."""

    @F.arrow_udf("string")
    def decode_ids(ids: pa.Array) -> pa.Array:
        bpe = tokenizer(path)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        sizes = np.fromiter((0 if n is None else n for n in ids.value_lengths().to_pylist()), np.int64, len(ids))
        ends = np.cumsum(sizes)
        return pa.array([bpe.decode(flat[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.string())

    return decode_ids


def round_tripper(path: str):
    """An Arrow UDF: string to its ids and what they decode to. A decoder over
    an encoder's column would have the optimizer encode every text twice."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def encode_and_decode(texts: pa.Array) -> pa.Array:
        bpe = tokenizer(path)
        ids = bpe.encode_batch(texts.to_pylist())
        return pa.StructArray.from_arrays([_ids_array(ids), pa.array(map(bpe.decode, ids), pa.string())], ["ids", "decoded"])

    return encode_and_decode


def encode(df: DataFrame, path: str, text: str | Column = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of a text column. Null and empty texts give an empty
    array; other columns stay as they are, and a column named ``out`` is replaced.
    Repeated rows are encoded each; whole texts count however long."""
    small_batches(df.sparkSession)
    col = F.col(f"`{text}`") if isinstance(text, str) else text
    return df.withColumn(out, encoder(path)(col))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of an ids column; the inverse of :func:`encode`."""
    small_batches(df.sparkSession)
    return df.withColumn(out, decoder(path)(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of a text column and with what they decode to: what
    :func:`decode` makes of :func:`encode`, in one pass. Odd rows as there."""
    small_batches(df.sparkSession)
    both = round_tripper(path)(F.col(f"`{text}`"))
    return df.withColumns({ids: both["ids"], decoded: both["decoded"]})
