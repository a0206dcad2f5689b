"""Importance resampling towards a target distribution, over hashed n-grams of words.

How often a feature occurs in the corpus is counted by segments. A separator cuts texts into lines, equal lines are
merged by one aggregate, the features of a distinct line are computed once and multiplied by its occurrences, and the
n-grams that run across lines are added from the words at the seams. The weight of a document is the sum of the log
ratios of target and corpus over its features; a Gumbel draw that is keyed by the id turns weights into a sample
without replacement, the highest scores.

Only counts by bucket reach the driver: ``buckets`` numbers for the corpus and as many for the target.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from regiotally.llm.rows import fresh, pieces_of, written
from regiotally.operators.position import with_position


@dataclass(frozen=True)
class Resampling:
    """Runs of 1 to ``longest`` words in ``buckets`` buckets; ``share`` per cent of texts of ``least_words`` are drawn."""

    buckets: int = 10_000
    longest: int = 3
    separator: str = "\n"
    scale: int = 1_000
    seed: int = 42
    least_words: int = 20
    share: int = 5

    def __post_init__(self) -> None:
        byte = self.separator.encode()
        if len(byte) != 1 or byte.isalnum() or byte[0] > 127:
            raise ValueError("the separator is one ASCII sign that is in no word")


#: Bytes of words stay, in lower case; every other ASCII sign parts words. Signs beyond ASCII are words.
_PLAIN = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def runs(units: list[list[bytes]], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``longest`` words inside each unit, and the number of the unit of each run."""
    flat = list(chain.from_iterable(units))
    owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
    spaced = [b" " + w for w in flat]
    hashes, places, owners = list(map(crc32, flat)), [], []
    for k in range(longest):
        if k:  # a run one word longer: the checksum of the shorter one goes on over a blank and the next word
            hashes = list(map(crc32, spaced[k:], hashes))
        inside = owner[k:] == owner[: len(owner) - k] if k else np.ones(len(owner), dtype=bool)
        places.append((np.array(hashes[: len(inside)], dtype=np.int64) % buckets)[inside])
        owners.append(owner[: len(inside)][inside])
    return np.concatenate(places), np.concatenate(owners)


def edges(line: bytes, keep: int) -> list[bytes]:
    """The first and last ``keep`` words of a line, or all where it has no more."""
    head = line.split(None, keep)
    return head if len(head) <= keep else head[:keep] + head[keep].rsplit(None, keep)[-keep:]


def seam_runs(text: bytes, how: Resampling) -> np.ndarray:
    """Buckets of the runs of words that cross from a line into a later one."""
    keep = how.longest - 1
    separator = how.separator.encode()
    blanks = _PLAIN if separator != b" " else _PLAIN.replace(b" ", b"\t")  # no other sign may turn into a separator
    plain = text.translate(blanks[: separator[0]] + separator + blanks[separator[0] + 1 :])
    lines = [e for e in (edges(line, keep) for line in plain.split(separator)) if e] if keep else []
    if len(lines) < 2:
        return np.zeros(0, dtype=np.int64)
    flat = list(chain.from_iterable(lines))
    owner = np.repeat(np.arange(len(lines)), [len(e) for e in lines])
    spaced, hashes, places = [b" " + w for w in flat], list(map(crc32, flat)), []
    for k in range(1, how.longest):
        hashes = list(map(crc32, spaced[k:], hashes))
        crossing = owner[k:] != owner[: max(len(owner) - k, 0)]
        places.append(np.array(hashes[: len(crossing)], dtype=np.int64)[crossing] % how.buckets)
    return np.concatenate(places)


def _rows_of(counts: np.ndarray) -> pa.RecordBatch:
    held = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["bucket", "n"])


def bucket_counts(docs: DataFrame, how: Resampling = Resampling(), text_column: str = "text") -> DataFrame:
    """``bucket, n``: how many features of all texts fall in each bucket that has any. Null texts have none.

    Lines are counted before they are shuffled, so a line that a third of the texts share is one row per task, and no
    group is gathered. Every task of both branches sends at most ``buckets`` rows on.
    """
    texts = docs.select(F.col(text_column).cast("string").alias("text")).filter("text is not null")
    lines = texts.select(F.explode(F.split("text", f"[{how.separator}]", -1)).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))

    def count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(how.buckets, dtype=np.int64)
        for batch in pieces_of(batches):
            places, owners = runs([words_of(line) for line in batch.column(0).to_pylist()], how.longest, how.buckets)
            np.add.at(counts, places, batch.column(1).to_numpy()[owners])
        yield _rows_of(counts)

    def count_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(how.buckets, dtype=np.int64)
        for batch in pieces_of(batches):
            crossing = [seam_runs(t, how) for t in batch.column(0).to_pylist()]
            counts += np.bincount(np.concatenate(crossing), minlength=how.buckets) if crossing else 0
        yield _rows_of(counts)

    inside = lines.select(F.col("line").cast("binary"), "n").mapInArrow(count_lines, "bucket int, n long")
    across = texts.select(F.col("text").cast("binary")).mapInArrow(count_seams, "bucket int, n long")
    return inside.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n"))


def counts_by_bucket(docs: DataFrame, how: Resampling = Resampling(), text_column: str = "text") -> np.ndarray:
    counts = np.zeros(how.buckets, dtype=np.int64)
    for row in bucket_counts(docs, how, text_column).collect():  # one number per bucket
        counts[row.bucket] = row.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray, how: Resampling = Resampling()) -> np.ndarray:
    """Per bucket the floor of ``scale`` times the log ratio of smoothed target and corpus frequency, in doubles."""
    s_all, t_all = float(corpus.sum() + how.buckets), float(target.sum() + how.buckets)
    ratios = [(float(t) + 1.0) * s_all / ((float(s) + 1.0) * t_all) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(how.scale * math.log(r)) for r in ratios], dtype=np.int64)


def draw(key: str, how: Resampling) -> int:
    """The Gumbel part of the score of an id."""
    h = int(hashlib.sha256(f"{how.seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-how.scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, how: Resampling = Resampling(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``n_features``, ``weight`` and ``score``. No shuffle."""
    rows = docs.select(F.col(id_column), F.col(id_column).cast("string").alias("_key"), F.col(text_column).cast("string").cast("binary").alias("_text"))
    names = ["n_words", "n_features", "weight", "score"]
    schema = T.StructType([rows.schema[0], *[T.StructField(n, T.LongType()) for n in names]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            units = [words_of(t or b"") for t in batch.column(2).to_pylist()]
            places, owners = runs(units, how.longest, how.buckets)
            features = np.bincount(owners, minlength=len(units))
            weight = np.zeros(len(units), dtype=np.int64)
            np.add.at(weight, owners, gain[places])
            drawn = np.array([draw(k or "", how) for k in batch.column(1).to_pylist()], dtype=np.int64)
            words = np.array([len(u) for u in units], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight, weight + drawn))], schema.names)

    return rows.mapInArrow(score, schema)


def resampled(docs: DataFrame, target: DataFrame, how: Resampling = Resampling(), id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_features``, ``weight``, ``score`` and its ``rank`` (null where it is not drawn).

    Of the N rows with ``least_words`` words the floor(``share`` * N / 100) highest scores are drawn; ties go to the
    smaller id, null ids after all others. A null text has no words; a null id is the empty key. Repeated rows are
    scored alike and take places one after the other. Empty tables give no rows; an empty target is a flat one.
    Other columns are not read. The scores, five numbers a row, are written once to the shared folder and ranked by
    slices of their order, so no task sees all of them.
    """
    gain = gains(counts_by_bucket(docs, how, text_column), counts_by_bucket(target, how, target_column), how)
    own = fresh(docs, "_place")
    rows = scored(docs, gain, how, id_column, text_column)
    kept = written(rows.withColumns({f"{own}_row": F.monotonically_increasing_id(), f"{own}_late": F.col("n_words") < how.least_words, f"{own}_low": -F.col("score"), f"{own}_none": F.col(id_column).isNull()}), "scores")
    drawn = kept.filter(F.col("n_words") >= how.least_words).count() * how.share // 100
    placed, _ = with_position(kept, [f"{own}_late", f"{own}_low", f"{own}_none", id_column, f"{own}_row"], own)
    return placed.select(id_column, "n_features", "weight", "score", F.when(F.col(own) <= drawn, F.col(own)).alias("rank"))
