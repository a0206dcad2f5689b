"""Token ids as files of bit planes.

Ids of all documents, in ascending order of their document id, form one stream that is cut into blocks of a fixed
number of ids. A block is transposed into bit planes (plane *b* holds bit *b* of every id), each plane is compressed
with zstandard, and empty planes take no bytes. A row of the data table is one block with its plane sizes and the
documents that begin in it; the index table has one row per slice (the part of the stream that one task wrote) with the
position of its first id.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from regiotally.llm.rows import pieces_of
from regiotally.llm.tree_bpe import UNEVEN

#: Ids of one block; the last block of a slice may hold fewer.
BLOCK_IDS = 65_536
LEVEL = 3
#: Segments kept per worker; the table is emptied when it is full.
CACHED = 600_000
#: Runs of letters kept per worker, of whatever marks follow.
CACHED_LETTERS = 300_000
LONG = 64

#: A segment of two matches of the split pattern at most: Latin letters, then marks.
SIMPLE = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")
#: The letters that stand for bytes in a byte-level vocabulary: printable bytes stand for themselves.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}

BLOCKS = T.StructType(
    [
        T.StructField("slice", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("n_ids", T.IntegerType()),
        T.StructField("plane_sizes", T.ArrayType(T.IntegerType())),
        T.StructField("planes", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_at", T.ArrayType(T.LongType())),
        T.StructField("doc_sizes", T.ArrayType(T.IntegerType())),
    ]
)


def pack(ids: np.ndarray, level: int = LEVEL) -> tuple[list[int], bytes]:
    """Sizes and bytes of the 32 compressed bit planes of unsigned 32-bit ids."""
    if not len(ids):
        return [0] * 32, b""
    squeeze = zstandard.ZstdCompressor(level=level)
    top = int(ids.max()).bit_length()
    planes = [squeeze.compress(np.packbits((ids >> np.uint32(b)) & np.uint32(1) != 0).tobytes()) for b in range(top)]
    return [len(p) for p in planes] + [0] * (32 - top), b"".join(planes)


def unpack(n_ids: int, sizes: list[int], planes: bytes) -> np.ndarray:
    ids, at = np.zeros(n_ids, dtype="<u4"), 0
    expand = zstandard.ZstdDecompressor()
    for b, size in enumerate(sizes):
        if size:
            bits = np.unpackbits(np.frombuffer(expand.decompress(planes[at : at + size]), dtype=np.uint8), count=n_ids)
            ids |= bits.astype("<u4") << np.uint32(b)
            at += size
    return ids


class SegmentEncoder:
    """The tokenizer's ids of whole texts.

    The split pattern of the tokenizer always cuts before a blank that a non-blank follows, so the segments between
    such places are encoded once by the library and looked up when they come again: those of letters and marks straight
    by its merges, the letters and the marks on their own, those joined by single line feeds too, others by all its steps. Texts with other runs of blanks go to the library whole.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        self.library.encode_special_tokens = True
        self.merges = self.library.model
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.line_feed = array("I", [t.id for t in self.merges.tokenize(BYTE_LETTERS[10])]).tobytes()

    def merged(self, piece: str) -> bytes:
        printed = piece.replace(" ", BYTE_LETTERS[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.merges.tokenize(printed)]).tobytes()

    def simple_ids(self, segment: str) -> bytes | None:
        """The ids of letters and marks, or None for any other segment."""
        simple = SIMPLE.fullmatch(segment)
        if simple is None:
            return None
        letters, marks = simple.groups()
        own = self.letters.get(letters)
        if own is None:
            own = self.merged(letters)
            if len(letters) <= LONG:
                self.letters[letters] = own
        if not marks:
            return own
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self.merged(marks)
        return own + self.marks[marks]

    def segment_ids(self, segments: list[str]) -> dict[str, bytes]:
        out, other = {}, []
        if len(self.letters) > CACHED_LETTERS:
            self.letters.clear()
        for s in segments:
            own = self.simple_ids(s)
            if own is None and "\n" in s:  # a single line feed between two others is a match of its own
                parts = [self.simple_ids(part) for part in s.split("\n")]
                own = None if None in parts else self.line_feed.join(parts)
            if own is None:
                other.append(s)
            else:
                out[s] = own
        out.update(zip(other, self.library_ids(other)))
        return out

    def library_ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if UNEVEN.search(t) else t.replace(" ", "\x00 ").split("\x00") for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        seen: set[str] = set()
        for parts in split:
            if parts is not None:
                seen.update(parts)
        found = self.segment_ids(list(seen.difference(known)))
        whole = iter(self.library_ids([t for t, parts in zip(texts, split) if parts is None]))
        known.update((s, ids) for s, ids in found.items() if len(s) <= LONG)
        longer = {s: ids for s, ids in found.items() if len(s) > LONG}
        out = []
        for parts in split:
            if parts is None:
                out.append(next(whole))
            elif longer and not longer.keys().isdisjoint(parts):
                out.append(b"".join([known[s] if s in known else longer[s] for s in parts]))
            else:
                out.append(b"".join(map(known.__getitem__, parts)))
        return out


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str) -> SegmentEncoder:
    return SegmentEncoder(tokenizer_path)


class _Stream:
    """Collects ids and documents of one slice and gives full blocks."""

    def __init__(self, number: int, block_ids: int):
        self.number, self.block_ids = number, block_ids
        self.parts: list[np.ndarray] = []
        self.held, self.first, self.block, self.at = 0, 0, 0, 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.at, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)
        self.at += len(ids)

    def blocks(self, end: bool = False) -> Iterator[list]:
        if self.held >= self.block_ids or end:
            flat = np.concatenate(self.parts) if self.parts else np.zeros(0, "<u4")
            while len(flat) >= self.block_ids or (end and (len(flat) or self.docs)):
                own, flat = flat[: self.block_ids], flat[self.block_ids :]
                sizes, planes = pack(own)
                here = [d for d in self.docs if d[1] < self.first + len(own)]
                self.docs = self.docs[len(here) :]
                yield [self.number, self.block, self.first, len(own), sizes, planes, [d[0] for d in here], [d[1] for d in here], [d[2] for d in here]]
                self.first += len(own)
                self.block += 1
            self.parts, self.held = [flat], len(flat)


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*rows), kinds)], BLOCKS.names)


def _packer(tokenizer_path: str, end_id: int, block_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(TaskContext.get().partitionId(), block_ids)
        own, close = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in pieces_of(batches, 2_000_000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(texts)):
                stream.add(doc_id, np.frombuffer(ids + close, dtype="<u4"))
                for row in stream.blocks():
                    yield _batch([row])
        for row in stream.blocks(end=True):
            yield _batch([row])

    return packed


def write_planes(docs: DataFrame, path: str, tokenizer_path: str, slices: int, end_id: int = 0, block_ids: int = BLOCK_IDS, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode the texts of ``docs`` and write ``path``/blocks and ``path``/index.

    Documents are dealt into ``slices`` ranges of their id and sorted by (id, text), nulls first, so a task that runs
    again writes the same blocks. A null text counts as empty; each document ends with ``end_id``. Repeated rows are
    repeated documents. Only the two named columns are read. A task holds one block and a few megabytes of text.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    ordered = rows.repartitionByRange(slices, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_packer(tokenizer_path, end_id, block_ids), BLOCKS).write.parquet(f"{path}/blocks")
    blocks = docs.sparkSession.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("slice").agg(F.max(F.col("first") + F.col("n_ids")).alias("n_ids"), F.count(F.lit(1)).alias("n_blocks"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per slice
    totals.select("slice", "n_blocks", "n_ids", before.alias("base")).write.parquet(f"{path}/index")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the slices in a task, from their blocks in order; a running checksum spans blocks."""
    waiting: list[list] = []
    for batch in batches:
        done: list[tuple] = []
        for row in batch.to_pylist():
            ids = unpack(row["n_ids"], row["plane_sizes"], row["planes"])
            waiting += [[d, row["slice"], at, size, 0, 0] for d, at, size in zip(row["doc_ids"], row["doc_at"], row["doc_sizes"])]
            kept = []
            for w in waiting:  # doc id, slice, place, size, ids seen, checksum
                here = ids[max(0, w[2] + w[4] - row["first"]) : w[2] + w[3] - row["first"]]
                w[5] = zlib.crc32(here.tobytes(), w[5])
                w[4] += len(here)
                (done if w[4] >= w[3] else kept).append(w)
            waiting = kept
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], type=t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (5, pa.int64()))],
            ["doc_id", "slice", "at", "n_tokens", "ids_crc32"],
        )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` is the number of ids of all documents before it. A slice is read by one task, block by block.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    index = spark.read.parquet(f"{path}/index")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = (
        blocks.repartition(n, "slice")
        .sortWithinPartitions("slice", "block")
        .mapInArrow(_reader, "doc_id long, slice int, at long, n_tokens long, ids_crc32 long")
    )
    return docs.join(index, "slice").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids of every block as an array, with the place of its first id in the stream."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = unpack(row["n_ids"], row["plane_sizes"], row["planes"]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]], pa.int32()), pa.array([row["first"]], pa.int64()), pa.array([own], pa.list_(pa.int32()))], ["slice", "first", "ids"])

    read = blocks.select("slice", "first", "n_ids", "plane_sizes", "planes").mapInArrow(ids, "slice int, first long, ids array<int>")
    return read.join(spark.read.parquet(f"{path}/index"), "slice").select((F.col("first") + F.col("base")).alias("start"), "ids")
