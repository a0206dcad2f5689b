"""Byte-level BPE by a monoid tree reduction.

A text is halved until the parts are short; the parts are encoded on their own and neighbours are joined. The split
pattern looks at most ``LOOK`` characters past the end of a match, and it never looks back. So everything of the left
part that ends ``LOOK`` characters before the seam stays, and the right part is settled from the first boundary that
the scan across the seam and the scan of the right part have in common. The window over the seam doubles until such a
boundary is found, at the latest at the end of the right part. Joining is associative, so any tree gives the ids of the
whole text. Decoding looks up the bytes of the ids and concatenates.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from regiotally.llm.rows import pieces_of

#: A match of the pattern is settled by the characters up to this many past its end: ``'re`` and a closing blank.
LOOK = 4
#: Characters of a part that is encoded at once.
LEAF = 4096
#: Segments longer than this are cut at every match of the pattern.
LONG = 64
#: Segments kept per worker; the table is emptied when it is full.
CACHED = 150_000
#: The blanks of the rank library's engine, which Python's ``\\s`` exceeds.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Before a blank with a non-blank after it there is always a boundary, whatever stands before.
UNITS = re.compile(r"(?= \S)")
UNEVEN = re.compile(r" \s| \Z|\x00")

Node = tuple[list[str], list[bytes]]


class TreeCodec:
    """Encodes and decodes with a rank file; ids are held as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.scan = regex.compile(pattern.replace(r"[^\s", f"[^{BLANKS}").replace(r"\S", f"[^{BLANKS}]").replace(r"\s", f"[{BLANKS}]"))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}

    def tokens(self, segments: list[str]) -> list[bytes]:
        known = self.known
        try:
            return [known[s] for s in segments]
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            fresh: dict[str, bytes] = {}
            for s in segments:
                if s not in known and s not in fresh:
                    ids = np.array(self.library.encode_ordinary(s), dtype="<u4").tobytes()
                    (known if len(s) <= LONG else fresh)[s] = ids
            return [known[s] if s in known else fresh[s] for s in segments]

    def leaf(self, text: str) -> Node:
        segments = UNITS.split(text) if UNEVEN.search(text) else text.replace(" ", "\x00 ").split("\x00")
        if not segments[0]:
            segments = segments[1:]
        if segments and max(map(len, segments)) > LONG:
            segments = [p for s in segments for p in (self.scan.findall(s) if len(s) > LONG else (s,))]
        return segments, self.tokens(segments)

    def join(self, left: Node, right: Node) -> Node:
        """The node of both texts together."""
        if not left[0] or not right[0]:
            return left if left[0] else right
        cut, held = len(left[0]), 0
        while cut and held < LOOK:
            cut -= 1
            held += len(left[0][cut])
        edge, n = "".join(left[0][cut:]), 1
        while True:
            window = edge + "".join(right[0][:n])
            matches = self.scan.findall(window)
            if n >= len(right[0]):
                rest = len(right[0])
                break
            ends, at = {}, 0
            for k, m in enumerate(matches):
                at += len(m)
                ends[at] = k + 1
            at, rest = len(edge), -1
            for k in range(n + 1):
                if at in ends and at + LOOK <= len(window):
                    rest, matches = k, matches[: ends[at]]
                    break
                at += len(right[0][k])
            if rest >= 0:
                break
            n *= 2
        return left[0][:cut] + matches + right[0][rest:], left[1][:cut] + self.tokens(matches) + right[1][rest:]

    def node(self, text: str) -> Node:
        """The tree over ``text``, folded pairwise; its depth is the logarithm of the length."""
        if len(text) <= LEAF:
            return self.leaf(text)
        level = [self.leaf(text[i : i + LEAF]) for i in range(0, len(text), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode(self, text: str) -> bytes:
        return b"".join(self.node(text)[1])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> TreeCodec:
    """One codec per worker process."""
    return TreeCodec(ranks_path, pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id column and ``ids``, an array of token ids. No shuffle.

    A null or empty text has no ids. Other columns are not read, so their names do not matter; repeated rows and null
    ids stay as they are. ``ranks_path`` must be readable on every executor.
    """
    rows = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return rows.mapInArrow(_encoder(ranks_path, pattern), schema)


def _encoder(ranks_path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in pieces_of(batches, 2_000_000):
            encoded = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
            np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
            flat = pa.array(np.frombuffer(b"".join(encoded), dtype="<i4"), type=pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], [batch.schema.names[0], "ids"])

    return encode


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column ``into``: the bytes of its ids. Null ids give empty bytes."""

    @F.pandas_udf(T.BinaryType())
    def decoded(ids):
        own = codec(ranks_path, pattern)
        return ids.map(lambda x: own.decode(x.tolist()) if x is not None else b"")

    return encoded.withColumn(into, decoded(F.col(ids_column)))


def digests(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", decoded_column: str = "decoded") -> DataFrame:
    """Counts and SHA-256 digests of ids and decoded bytes."""
    ids = F.coalesce(F.col(ids_column), F.array().cast("array<int>"))
    return encoded.select(
        F.col(id_column),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_column), 256).alias("decoded_sha256"),
    )
