"""Benchmark decontamination by latent semantic retrieval.

1. Passages of 64 words of all documents and items become TF-IDF vectors over the items' own words; words that more
   than ``MOST_SHARE`` of the passages have are left out. Counts cover every document.
2. A randomised singular value decomposition finds the leading directions of these vectors: tasks add up ``A^T (A R)``
   for a random ``R``, a sum of fixed size, and the directions follow from it (Nystroem's form). The item passages weigh
   as much in it as all others together, and there are more directions than item passages, so each is well kept.
3. Overlapping windows of every document are compared with every item passage by cosine in that space; a candidate
   must also hold a good part of the passage's weight, as a single rare word points the same way.
4. Candidates must share a longest common subsequence of words with the item, and the item's answer (its last sentence)
   must be there, so paraphrases with changed words are found and chance likeness is not.
5. No cosine is sure to reach every such text, so stretches that hold enough of an item's words, common or rare, are
   candidates too. A common subsequence needs these words, so nothing that passes step 4 in one stretch is left out,
   whatever surrounds it and however many documents hold the same.

Items are treated in blocks that bound what is sent to the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from regiotally.llm.rows import pieces_of, written

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.?!\n]+")
PASSAGE = 64
STRIDE = 32
#: Word hashes are folded to so many features at most.
FEATURES = 16_384
MOST_SHARE = 0.005
#: Directions beyond the number of item passages.
SPARE_RANK = 56
OVERSAMPLED = 8
#: A block of the benchmark: items and words; a longer item is a block of its own.
BLOCK_ITEMS = 1_000
BLOCK_WORDS = 100_000
COSINE = 0.4
HELD = 0.3
COMMON = 0.75
ANSWER = 0.5
#: Items with fewer words are no evidence of a leak.
LEAST_WORDS = 4
#: Items with fewer words of weight have no latent vector.
LEAST_TERMS = 3
#: An item of fewer words is like many texts by chance: its words must stand in a stretch of its own length / ``COMMON``.
SHORT = 12
#: Words of a document that are looked at together, at least.
REACH = 256
#: Words of more than one in so many items are a row of a matrix, others a list of their items.
RARE = 32


@dataclass
class Item:
    item_id: object
    words: list[str]
    answer: list[str]


def items_of(rows: list[tuple[object, str | None]]) -> list[Item]:
    out = []
    for item_id, text in rows:
        words = WORD.findall((text or "").lower())
        if len(words) >= LEAST_WORDS:
            sentences = [w for s in SENTENCE.split(text.lower()) if (w := WORD.findall(s))]
            out.append(Item(item_id, words, sentences[-1] if len(sentences) > 1 else []))
    return out


def common_subsequence(pattern: list[str], text: list[str]) -> int:
    """Length of the longest common subsequence; one bit per word of ``pattern``."""
    places: dict[str, int] = {}
    for k, w in enumerate(pattern):
        places[w] = places.get(w, 0) | (1 << k)
    row = full = (1 << len(pattern)) - 1
    for w in text:
        m = row & places.get(w, 0)
        if m:
            row = ((row + m) | (row - m)) & full
    return len(pattern) - row.bit_count()


class Coverage:
    """How much of every item stands in a piece of text, by all words of the items. Its size is linear in the items."""

    def __init__(self, items: list[Item]) -> None:
        self.lengths = np.array([len(item.words) for item in items], dtype=np.int64)
        self.spans = [int(n / COMMON) if n < SHORT else PASSAGE + 2 * n for n in self.lengths.tolist()]
        self.reach = max([REACH, *self.spans])
        places: dict[str, list[int]] = {}
        for k, item in enumerate(items):
            for w in item.words:
                places.setdefault(w, []).append(k)
        # words of many items come first and are rows of a table, the others are lists of items one after the other
        often = [w for w, own in places.items() if len(set(own)) * RARE > len(items)]
        self.table = np.zeros((len(often), len(items)), dtype=np.int32)
        for n, w in enumerate(often):
            np.add.at(self.table[n], places[w], 1)
        often_set = set(often)
        rare = [w for w in places if w not in often_set]
        self.number = {w: n for n, w in enumerate([*often, *rare])}
        self.owners = [np.array(places[w], dtype=np.int64) for w in rare]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 for words of no item."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def enough(self, numbers: np.ndarray) -> list[int]:
        """Items that have so many of their words among ``numbers`` that a common subsequence may be long enough."""
        seen = np.zeros(len(self.number) + 1, dtype=bool)
        seen[numbers] = True  # the last place takes the words of no item
        own = np.flatnonzero(seen[:-1])
        cut = np.searchsorted(own, len(self.table))
        held = self.table[own[:cut]].sum(axis=0)
        if cut < len(own):
            rare = np.concatenate([self.owners[n] for n in (own[cut:] - len(self.table)).tolist()])
            held = held + np.bincount(rare, minlength=len(held))
        return np.flatnonzero(held / self.lengths >= COMMON).tolist()

    def stretches(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, end) of pieces that overlap by the longest span, so that every span is whole in one of them."""
        for first in range(0, max(1, len(numbers) - self.reach), self.reach):
            end = min(len(numbers), first + 2 * self.reach)
            for k in self.enough(numbers[first:end]):
                yield k, first, end


@dataclass
class Matcher:
    """All that a task needs to find leaks of one block of items; its size is bounded by the block."""

    items: list[Item]
    features: dict[str, int]
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # feature -> weighted latent vector
    passages: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # unit vectors of item passages
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # and their lengths before
    owner: list[int] = field(default_factory=list)
    coverage: Coverage | None = None

    @cached_property
    def _rows(self) -> np.ndarray:
        """Row of ``vectors`` of each numbered word, -1 without one; the last place is that of words of no item."""
        rows = np.full(len(self.coverage.number) + 1, -1, dtype=np.int64)
        for w, n in self.coverage.number.items():
            rows[n] = self.features.get(w, -1)
        return rows

    def leaks(self, text: str | None) -> list[tuple[int, float, float, bool, int]]:
        """(item, cosine, common share, answer found, first word of the window), the best of each item."""
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.coverage:
            return []
        best: dict[int, tuple[int, float, float, bool, int]] = {}
        numbers = self.coverage.numbers(words)  # one look at each word serves both searches
        own = self._rows[numbers]
        at = np.flatnonzero(own >= 0)
        if len(at) and len(self.passages):
            vectors = self.vectors[own[at]]
            half = at // STRIDE
            starts = np.flatnonzero(np.concatenate([[True], half[1:] != half[:-1]]))
            sums = np.add.reduceat(vectors, starts, axis=0)
            halves = np.zeros((half[-1] + 2, sums.shape[1]), dtype=np.float32)
            halves[half[starts]] = sums
            stacked = halves[:-1] + halves[1:]  # a window is two halves
            norms = np.linalg.norm(stacked, axis=1)
            near = stacked @ self.passages.T
            for w, p in zip(*np.nonzero((near >= COSINE * np.maximum(norms, 1e-6)[:, None]) & (near >= HELD * self.lengths))):
                k, first = self.owner[p], int(w) * STRIDE
                if k in best and best[k][2] >= 1.0:
                    continue
                found = self._checked(k, float(near[w, p] / max(norms[w], 1e-6)), words, first)
                if found and (k not in best or found[2] > best[k][2]):
                    best[k] = found
        for k, first, end in self.coverage.stretches(numbers):
            if k not in best or best[k][2] < 1.0:
                found = self._covered(k, words, first, end)
                if found and (k not in best or found[2] > best[k][2]):
                    best[k] = found
        return [best[k] for k in sorted(best)]

    def _covered(self, k: int, words: list[str], first: int, end: int) -> tuple[int, float, float, bool, int] | None:
        """The best span of item ``k`` in a piece of ``words``. Other words than the item's own are passed over."""
        item, span = self.items[k], self.coverage.spans[k]
        own, size = set(item.words), len(item.words)
        at = [i for i in range(first, end) if words[i] in own]
        best, stop, tried = None, 0, 0
        for n, start in enumerate(at):
            while stop < len(at) and at[stop] < start + span:
                stop += 1
            if stop - n < COMMON * size:
                continue
            if stop == tried:  # a part of a span that is too little
                continue
            common = common_subsequence(item.words, [words[i] for i in at[n:stop]]) / size
            if common < COMMON or best and common <= best[2]:
                tried = stop
                continue
            region = words[max(0, start - size) : start + span + size]
            answered = not item.answer or common_subsequence(item.answer, region) >= ANSWER * len(item.answer)
            if answered or common >= 0.9:
                best = (k, self._cosine(k, words[start : start + PASSAGE]), common, answered, start)
                if common >= 1.0:
                    break
        return best

    def _cosine(self, k: int, words: list[str]) -> float:
        """The best cosine of a passage of item ``k``; 0 where no word has weight."""
        own, passages = [f for w in words if (f := self.features.get(w)) is not None], [p for p, owner in enumerate(self.owner) if owner == k]
        if not own or not passages:
            return 0.0
        vector = self.vectors[own].sum(axis=0)
        return float((self.passages[passages] @ vector).max() / max(np.linalg.norm(vector), 1e-6))

    def _checked(self, k: int, cosine: float, words: list[str], first: int) -> tuple[int, float, float, bool, int] | None:
        item = self.items[k]
        region = words[max(0, first - len(item.words)) : first + PASSAGE + len(item.words)]
        common = common_subsequence(item.words, region) / len(item.words)
        if common < COMMON:
            return None
        answered = not item.answer or common_subsequence(item.answer, region) >= ANSWER * len(item.answer)
        return (k, cosine, common, answered, first) if answered or common >= 0.9 else None


def _passage_counts(docs: DataFrame, features: dict[str, int], text_column: str) -> DataFrame:
    """Packed (passage, feature, count) triples of all documents, a row per few megabytes of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in pieces_of(batches, 8_000_000):
            keys, passages = [], 0
            for text in batch.column(0).to_pylist():
                words = WORD.findall(text.lower()) if text else []
                own = np.array(list(map(features.get, words, repeat(-1))), dtype=np.int64)
                at = np.flatnonzero(own >= 0)
                keys.append((at // PASSAGE + passages) * FEATURES + own[at])
                passages += -(-len(words) // PASSAGE)
            flat, times = np.unique(np.concatenate(keys), return_counts=True)
            packed = squeeze.compress((flat // FEATURES).astype("<u4").tobytes() + (flat % FEATURES).astype("<u2").tobytes() + np.minimum(times, 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([passages], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([packed], pa.binary())], ["passages", "n", "packed"])

    return docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(count, "passages long, n long, packed binary")


def _triples(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    expand = zstandard.ZstdDecompressor()
    for passages, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
        raw = expand.decompress(packed)
        yield passages, np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<u2", n, 4 * n), np.frombuffer(raw, "<u2", n, 6 * n)


def _document_frequency(counts: DataFrame) -> tuple[np.ndarray, int]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for more, _, feature, _ in _triples(batch):
                total += np.bincount(feature, minlength=FEATURES)
                passages += more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(total[seen], passages), pa.int64())], ["feature", "n"])

    found = counts.mapInArrow(add, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    frequency = np.zeros(FEATURES, dtype=np.int64)
    for r in found:
        if r["feature"] >= 0:
            frequency[r["feature"]] = r["n"]
    return frequency, sum(r["n"] for r in found if r["feature"] < 0)


def _summed(counts: DataFrame, place: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum of ``A^T (A start)`` over all passages.

    place: feature -> row of ``start`` or -1; weight: of the rows. Each task sends one row per row of the sum, and
    another shuffle adds them up by row.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(start.shape, dtype=np.float32)
        for batch in batches:
            for _, passage, feature, times in _triples(batch):
                rows = place[feature]
                keep = rows >= 0
                if not keep.any():
                    continue
                rows, values = rows[keep], (times[keep] * weight[rows[keep]]).astype(np.float32)
                starts = np.flatnonzero(np.concatenate([[True], np.diff(passage[keep].astype(np.int64)) != 0]))
                for lo in range(0, len(starts), 5_000):  # bounded blocks of passages
                    a, b = starts[lo], starts[lo + 5_000] if lo + 5_000 < len(starts) else len(rows)
                    own = starts[lo : lo + 5_000] - a
                    projected = np.add.reduceat(start[rows[a:b]] * values[a:b, None], own, axis=0)
                    order = np.argsort(rows[a:b], kind="stable")
                    ranked = rows[a:b][order]
                    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                    number = np.repeat(np.arange(len(own)), np.diff(np.append(own, b - a)))[order]
                    total[ranked[first]] += np.add.reduceat(projected[number] * values[a:b][order][:, None], first, axis=0)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([total[k].tobytes() for k in used], pa.binary())], ["row", "vector"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = np.frombuffer(vector, dtype=np.float32).astype(float)
                sums[row] = sums[row] + value if row in sums else value
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["row", "vector"])

    parts = counts.mapInArrow(add, "row long, vector binary").repartition("row").mapInArrow(merge, "row long, vector binary")
    total = np.zeros(start.shape)
    for r in parts.toArrow().to_pylist():
        total[r["row"]] = np.frombuffer(r["vector"])
    return total


def leading(image: np.ndarray, start: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive matrix ``M`` from ``image = M start`` alone (randomised Nystroem form)."""
    shift = 1e-7 * np.linalg.norm(image)
    moved = image + shift * start
    inner = start.T @ moved
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    half = turn / np.sqrt(np.maximum(values, 1e-12 * values.max()))
    return np.linalg.svd(moved @ half, full_matrices=False)[0][:, :rank]


def fitted(docs: DataFrame, items: list[Item], text_column: str = "text") -> Matcher:
    """The matcher of one block of items, its weights and directions taken from all passages of ``docs`` and the items."""
    features = {w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES for item in items for w in item.words}
    matcher = Matcher(items, features, coverage=Coverage(items) if items else None)
    queries = [(k, item.words[i : i + PASSAGE]) for k, item in enumerate(items) for i in range(0, len(item.words), PASSAGE)]
    if not items:
        return matcher
    spark = docs.sparkSession
    own = spark.createDataFrame([(" ".join(words),) for _, words in queries], "text string")
    counts = written(_passage_counts(docs.select(F.col(text_column).cast("string").alias("text")).unionByName(own), features, "text"), "passages")
    frequency, passages = _document_frequency(counts)
    wanted = np.flatnonzero((frequency > 0) & (frequency <= max(MOST_SHARE * passages, 5)))
    place = np.full(FEATURES, -1, dtype=np.int64)
    place[wanted] = np.arange(len(wanted))
    weight = np.log((1 + passages) / (1 + frequency[wanted])) + 1
    matcher.features = {w: int(place[f]) for w, f in features.items() if place[f] >= 0}
    terms = [sum(w in matcher.features for w in item.words) for item in items]
    if not len(wanted):
        return matcher
    own_rows = np.zeros((len(queries), len(wanted)))
    for n, (_, words) in enumerate(queries):
        np.add.at(own_rows[n], [matcher.features[w] for w in words if w in matcher.features], 1.0)
    own_rows *= weight
    rank = min(len(queries) + SPARE_RANK, len(wanted))
    start = np.random.default_rng(7).standard_normal((len(wanted), min(rank + OVERSAMPLED, len(wanted))))
    image = _summed(counts, place, weight, start.astype(np.float32)) + passages / len(queries) * (own_rows.T @ (own_rows @ start))
    directions = leading(image, start, rank)
    matcher.vectors = (directions * weight[:, None]).astype(np.float32)
    inside = own_rows @ directions
    lengths, whole = np.linalg.norm(inside, axis=1), np.linalg.norm(own_rows, axis=1)
    kept = np.array([n for n in np.flatnonzero(lengths > 0.5 * whole) if terms[queries[n][0]] >= LEAST_TERMS], dtype=np.int64)
    owner = [queries[n][0] for n in kept]
    matcher.passages = (inside[kept] / lengths[kept, None]).astype(np.float32)
    matcher.lengths = lengths[kept].astype(np.float32)
    matcher.owner = owner
    return matcher


def blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[list[Item]]:
    """The items in blocks of bounded size, read one after the other."""
    held, words = [], 0
    rows = benchmark.select(F.col(id_column), F.col(text_column).cast("string")).filter(F.col(text_column).isNotNull()).orderBy(id_column, text_column)
    for row in rows.toLocalIterator():
        for item in items_of([(row[0], row[1])]):
            if held and (len(held) >= BLOCK_ITEMS or words + len(item.words) > BLOCK_WORDS):
                yield held
                held, words = [], 0
            held.append(item)
            words += len(item.words)
    if held:
        yield held


def contaminations(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """One row per row of ``docs`` and item found in it: ids, ``cosine``, ``common`` share, ``answered``, ``first_word``.

    Null or empty texts have no rows, null ids are kept, repeated rows repeat their findings. Items of under 4 words
    are not looked for. An empty benchmark gives no rows.
    """
    kinds = f"{id_column} {docs.select(id_column).schema[0].dataType.simpleString()}, {item_column} {benchmark.select(item_column).schema[0].dataType.simpleString()}"
    schema = f"{kinds}, cosine double, common double, answered boolean, first_word long"
    out = None
    for items in blocks(benchmark, item_column):
        found = docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(_finder(fitted(docs, items, text_column)), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _finder(matcher: Matcher):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            rows, own = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for found in matcher.leaks(text):
                    rows.append(k)
                    own.append(found)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            columns = [pa.array([matcher.items[f[0]].item_id for f in own]), *[pa.array([f[j] for f in own], t) for j, t in ((1, pa.float64()), (2, pa.float64()), (3, pa.bool_()), (4, pa.int64()))]]
            if own:
                yield pa.RecordBatch.from_arrays([ids, *columns], [batch.schema.names[0], "item", "cosine", "common", "answered", "first_word"])

    return find


def leaking(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> Column:
    """A boolean column over the text: it holds an item of the benchmark. For filters without a shuffle."""
    out = F.lit(False)
    for items in blocks(benchmark):
        out = out | _leak_column(fitted(docs, items, text_column))(F.col(text_column).cast("string"))
    return out


def _leak_column(matcher: Matcher):
    @F.pandas_udf(T.BooleanType())
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bool(matcher.leaks(t)) for t in texts], dtype=bool)

    return leaks
