"""Fill-in-middle transformation by repeated-capture matching.

A text is a tiling of units, by default its lines. One ``fullmatch`` of the regex library against ``(unit)*`` keeps every
repetition of the group: ``match.ends(1)`` are the ends of all units at once, their number is ``n`` and the two places
where the text is cut are two of its entries. Where the cuts lie, whether a text is transformed at all and in which
form follows from a keyed digest of its id, so a retry or a run on other machines gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from regiotally.llm.rows import fresh, pieces_of

LINE = r"[^\n]*\n|[^\n]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Filling:
    """``rate`` and ``spm`` are per cent of all texts and of the transformed ones; ``seed`` keys the digests."""

    unit: str = LINE
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    rate: int = 100
    spm: int = 50
    seed: int = 7

    def __post_init__(self) -> None:
        # a mark must never arise across the seam of text and mark, else an output could be read in two ways
        starts = {m[:1] for m in self.marks}
        if "" in starts or len(set(self.marks)) < 3 or any(c in m[1:] for m in self.marks for c in starts):
            raise ValueError("marks must differ, and the first sign of a mark may stand nowhere else in one")

    def draws(self, key: str) -> tuple[int, int, int, int]:
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).hexdigest()
        return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


@lru_cache(maxsize=8)
def tiling(unit: str) -> regex.Pattern:
    """``(unit)*``; possessive, as units are taken left to right and never given back."""
    return regex.compile(f"({unit})*+")


def unit_ends(text: str, unit: str = LINE) -> list[int]:
    """The end of every unit of ``text``, from one match."""
    match = tiling(unit).fullmatch(text)
    if match is None:
        raise ValueError("the units do not cover the text")
    return match.ends(1)


def fill(text: str, key: str, how: Filling) -> tuple[int, str, str, int | None, int | None]:
    """Number of units, form, output, and code points of prefix and middle (None if plain)."""
    ends = unit_ends(text, how.unit)
    n = len(ends)
    first, second, chance, kind = how.draws(key)
    if not text or any(m in text for m in how.marks) or chance % 100 >= how.rate:
        return n, PLAIN, text, None, None
    low, high = sorted((first % (n + 1), second % (n + 1)))
    start, stop = (ends[k - 1] if k else 0 for k in (low, high))
    before, after, between = how.marks
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    if kind % 100 < how.spm:
        return n, SPM, f"{after}{suffix}{before}{prefix}{between}{middle}", len(prefix), len(middle)
    return n, PSM, f"{before}{prefix}{after}{suffix}{between}{middle}", len(prefix), len(middle)


def unfill(output: str, form: str, marks: tuple[str, str, str]) -> str:
    """The text that ``fill`` was given, from its output and form alone."""
    if form == PLAIN:
        return output
    before, after, between = marks
    one, two = (after, before) if form == SPM else (before, after)
    first, rest = output[len(one) :].split(two, 1)
    second, middle = rest.split(between, 1)
    return f"{second}{middle}{first}" if form == SPM else f"{first}{middle}{second}"


def filled(docs: DataFrame, how: Filling = Filling(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n`` units, ``form``, ``output``, ``prefix_chars``, ``middle_chars``.

    A null text counts as empty and stays plain, as does a text that holds a mark. A null id is the empty key; repeated
    rows give repeated results. Other columns are not read, so their names do not matter. No shuffle; a text of any
    length is one match.
    """
    rows = docs.select(F.col(id_column), F.col(id_column).cast("string").alias("_key"), F.col(text_column).cast("string").alias("_text"))
    schema = T.StructType(
        [
            rows.schema[0],
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("output", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
        ]
    )

    def fill_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            made = [fill(t or "", k or "", how) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*made), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return rows.mapInArrow(fill_all, schema)


def restored(how: Filling, output: str = "output", form: str = "form") -> Column:
    """The exact text, rebuilt from the columns ``output`` and ``form``."""
    marks = how.marks

    @F.pandas_udf(T.StringType())
    def rebuilt(outputs, forms):
        return outputs.combine(forms, lambda o, f: unfill(o, f, marks))

    return rebuilt(F.col(output), F.col(form))


def digests(docs: DataFrame, how: Filling = Filling(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``filled`` with digests of the output and of the text that is rebuilt from it, in place of the output."""
    made = filled(docs, how, id_column, text_column)
    own = fresh(made, "_restored")
    return made.withColumn(own, restored(how)).select(
        F.col(id_column),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col(own).cast("binary"), 256).alias("restored_sha256"),
    )
