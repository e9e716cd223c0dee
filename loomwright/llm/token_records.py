"""Token ids as length-delimited binary records with a separate offset index.

A record is a frame around one serialized document::

    u64 length | u32 masked checksum of the 8 length bytes | payload | u32 masked checksum of the payload

all little-endian; the payload is ``i64 doc_id``, ``u8`` width of an id in bytes
(2 or 4; with the highest bit: the doc_id is null) and the ids. A checksum is a CRC-32, masked by
a rotation and an addition, so that a checksum over data that hold checksums
stays sound. Each task writes its range of ids into files of its own attempt;
the index (file, place, doc_id, offset, length, tokens), a Parquet table that
commits only what finished tasks report, is what names the valid files and lets
a reader fetch single records in any order.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomwright.llm.bpe import byte_alphabet
from loomwright.llm.common import qualified, scratch_root, small_batches, stored

FILE_BYTES = 64 << 20
NO_ID = 0x80
CACHE_PIECES, CACHE_WORDS, CACHE_CHARS = 700_000, 500_000, 48
INDEX = "file string, part int, place long, doc_id long, offset long, length long, tokens long"
PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([,.;:!?]?)\Z")
SPACES = re.compile(r"[ \t-\r]+")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def frames(stream, name: str) -> Iterator[tuple[int, bytes]]:
    """Offsets and payloads of a file; raises ValueError where a checksum fails."""
    at = 0
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError(f"{name}: bad length at byte {at}")
        size = struct.unpack("<Q", head[:8])[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
            raise ValueError(f"{name}: bad record at byte {at}")
        yield at, body[:size]
        at += size + 16


def packed(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    kind = "<u2" if width == 2 else "<u4"
    return struct.pack("<qB", doc_id or 0, width | (NO_ID if doc_id is None else 0)) + ids.astype(kind).tobytes()


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack_from("<qB", payload)
    ids = np.frombuffer(payload, "<u2" if width & ~NO_ID == 2 else "<u4", offset=9)
    return (None if width & NO_ID else doc_id), ids


def store(root: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder, by whatever scheme it has, as executors reach it."""
    if re.match(r"file:/(?!//)", root) or "://" not in root:
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", root)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", root)))


class PieceEncoder:
    """The tokenizers library behind a bounded cache of white-space pieces.

    No step of the vocabulary's normaliser or pre-tokenizer reaches across
    ASCII white space, so pieces encode alone as they do within the text. Of
    pieces that are Latin letters and at most one mark of punctuation, the
    letters, in lower case, and the mark are looked up apart; such letters are
    one word to the pre-tokenizer, so the library's model takes them as they
    are. Everything else goes through the whole pipeline."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        letter = {b: c for c, b in byte_alphabet().items()}
        self.as_bytes = {i: "".join(letter[b] for b in chr(i).encode()) for i in range(256)}
        self.code = "H" if self.width == 2 else "I"
        self.marks = {m: array(self.code, self.lib.encode(m, add_special_tokens=False).ids).tobytes() for m in ",.;:!?"}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        known, tokenize, made, odd = self.words, self.lib.model.tokenize, self.pieces, []
        for p in pieces:
            if p.isascii() and p.isalpha():
                word, mark = p.lower(), ""
            elif p[-1] in self.marks and (body := p[:-1]).isascii() and body.isalpha():
                word, mark = body.lower(), p[-1]
            elif m := PLAIN.match(p):
                word, mark = m[1].lower(), m[2]
            else:
                odd.append(p)
                continue
            if (coded := known.get(word)) is None:
                letters = word if word.isascii() else word.translate(self.as_bytes)
                coded = known[word] = array(self.code, [t.id for t in tokenize(letters)]).tobytes()
            made[p] = coded + self.marks[mark] if mark else coded
        for p, e in zip(odd, self.lib.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            made[p] = array(self.code, e.ids).tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for text in texts:
            coded = []
            for piece_list in self._lists(text or ""):
                new = set(piece_list).difference(self.pieces)
                if new:
                    if len(self.pieces) + len(new) > CACHE_PIECES:
                        self.pieces, new = {}, set(piece_list)
                    if len(self.words) > CACHE_WORDS:
                        self.words = {}
                    self._learn(list(new))
                coded.append(b"".join(map(self.pieces.__getitem__, piece_list)))
                for p in new:
                    if len(p) > CACHE_CHARS:
                        del self.pieces[p]
                        if m := PLAIN.match(p):
                            self.words.pop(m[1].lower(), None)
            out.append(np.frombuffer(b"".join(coded), self.kind))
        return out

    @staticmethod
    def _lists(text: str, chars: int = 1 << 20) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            end = m.end() if at + chars < len(text) and (m := SPACES.search(text, at + chars)) else len(text)
            part = text[at:end]
            # str.split parts at all white space that the normaliser squeezes, and at four controls that it keeps
            plain = not any(c in part for c in "\x1c\x1d\x1e\x1f")
            yield part.split() if plain else [p for p in SPACES.split(part) if p]
            at = end


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_records(docs: DataFrame, root: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of ``docs``, ascending by id, below ``root``; the index.

    Null texts count as empty and give a record with the end id alone; null
    ids come first. Rows that share an id stay apart, ordered by text. An empty
    table gives an empty index. Files of attempts that failed stay unnamed."""
    spark = docs.sparkSession
    small_batches(spark)
    root = qualified(spark, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        fs.create_dir(base, recursive=True)
        coder, task = piece_encoder(path), TaskContext.get()
        part, n, out, name, at, place = task.partitionId(), 0, None, "", 0, 0
        for batch in batches:
            rows = []
            coded = coder.encode_batch(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"ids-{part:06d}-{n:04d}-{uuid.uuid4().hex}.rec"
                    out, at, n = fs.open_output_stream(f"{base}/{name}"), 0, n + 1
                frame = framed(packed(doc_id, np.append(ids, end_id), coder.width))
                out.write(frame)
                rows.append((name, part, place, doc_id, at, len(frame), len(ids) + 1))
                at, place = at + len(frame), place + 1
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split(" ")[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ranged.mapInArrow(write, INDEX), "ids-index")


def read_records(spark: SparkSession, root: str, index: DataFrame) -> DataFrame:
    """Read back the files that the index names: doc_id, start, n_tokens, ids_crc32.

    ``start`` is the number of ids of all documents before; files are read by
    one task each, in any order, since the index gives each file's start."""
    root = qualified(spark, root)
    files = index.groupBy("part", "file").agg(F.min("place").alias("place"), F.sum("tokens").alias("tokens"))
    before = W.Window.orderBy("part", "place").rowsBetween(W.Window.unboundedPreceding, -1)
    files = files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with fs.open_input_stream(f"{base}/{name}", buffer_size=1 << 20) as stream:
                    for _, payload in frames(stream, name):
                        doc_id, ids = unpacked(payload)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.repartition("file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(root: str, file: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index: the reader of shuffled reads."""
    fs, base = store(root)
    with fs.open_input_file(f"{base}/{file}") as f:
        f.seek(offset)
        _, payload = next(frames(f, file))
    return unpacked(payload)


def fresh_root(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/records-{uuid.uuid4().hex}"
