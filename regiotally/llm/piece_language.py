"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A letter run of a text ("word") is
generated by any sequence of pieces that spells it, so its probability is the sum over all its segmentations, computed
by a forward pass over its characters; the words of a text multiply. Training starts from equal piece weights, takes
the expected piece counts of every word (forward and backward pass) and normalises them per language.

Words are treated in blocks of equal length as numpy arrays, each distinct word of a block once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F, types as T

from regiotally.llm.rows import pieces_of

WORD = re.compile(r"[^\W\d_]+")
#: The mark of a word start in the vocabulary.
START = "▁"
#: Words beyond this many characters are scored one by one; in training they are counted in stretches of this length.
SHORT = 40
#: Keeps products of piece probabilities in range; it cancels out between languages.
SCALE = 300.0
#: Added to every piece count.
SMOOTHING = 0.05
#: Distinct words kept at a time, in training and per worker in prediction.
CACHED = 120_000
#: More languages than this are a wrong column.
MOST_LANGUAGES = 500
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces of a sentencepiece file as hashes of their characters; one more id stands for unknown characters."""

    def __init__(self, model_path: str):
        own = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = {own.id_to_piece(i).lower() for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))}
        self.pieces = sorted(pieces)
        self.ids = {p: k for k, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        self.unknown = len(self.pieces)
        self.size = len(self.pieces) + 1
        hashes = np.array([self._hash(p) for p in self.pieces], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length: (begin, end, rows, piece ids) of all pieces in them, by ascending end."""
        n = len(words[0]) + 1
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), dtype="<u4").reshape(len(words), n).astype(np.uint64)
        prefix = np.zeros((n + 1, len(words)), dtype=np.uint64)
        powers = np.ones(n + 1, dtype=np.uint64)
        for k in range(n):
            prefix[k + 1] = prefix[k] * _BASE + codes[:, k]
            powers[k + 1 : k + 2] = powers[k : k + 1] * _BASE  # as an array, so that it wraps without a warning
        everyone = np.arange(len(words))
        for end in range(1, n + 1):
            for begin in range(max(0, end - self.longest), end):
                h = prefix[end] - prefix[begin] * powers[end - begin]
                at = np.searchsorted(self.hashes, h)
                at[at == len(self.hashes)] = 0
                rows = np.nonzero(self.hashes[at] == h)[0]
                if len(rows):
                    yield begin, end, rows, self.order[at[rows]]
                if end - begin == 1 and len(rows) < len(words):
                    rest = np.setdiff1d(everyone, rows, assume_unique=True)
                    yield begin, end, rest, np.full(len(rest), self.unknown)

    def scores(self, words: list[str], chances: np.ndarray) -> np.ndarray:
        """Log probability of each word and language; ``chances`` is pieces by languages."""
        out = np.zeros((len(words), chances.shape[1]))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, members in by_length.items():
            if length > SHORT:
                for k in members:
                    out[k] = self._long(words[k], chances)
                continue
            for start in range(0, len(members), 20_000):
                own = members[start : start + 20_000]
                forward = np.zeros((length + 2, len(own), chances.shape[1]))
                forward[0] = 1.0
                for begin, end, rows, ids in self.spans([words[k] for k in own]):
                    forward[end, rows] += forward[begin, rows] * chances[ids] * SCALE ** (end - begin)
                out[own] = np.log(forward[-1]) - (length + 1) * np.log(SCALE)
        return out

    def _long(self, word: str, chances: np.ndarray) -> np.ndarray:
        text, shift = START + word, np.zeros(chances.shape[1])
        recent = [np.ones(chances.shape[1])]  # forward values of the last positions, rescaled by ``shift``
        for end in range(1, len(text) + 1):
            value = np.zeros(chances.shape[1])
            for back in range(1, min(self.longest, end) + 1):
                piece = self.ids.get(text[end - back : end], self.unknown if back == 1 else -1)
                if piece >= 0:
                    value = value + recent[-back] * chances[piece]
            recent = [*recent[-self.longest :], value]
            top = value.max()
            if top < 1e-100:
                recent = [r / top for r in recent]
                shift = shift + np.log(top)
        return np.log(np.maximum(recent[-1], 1e-300)) + shift

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected counts, pieces by languages, of words that occur ``weights`` (words by languages) times."""
        total = np.zeros((self.size, weights.shape[1]))
        parts: dict[int, list[tuple[str, int]]] = {}
        for k, w in enumerate(words):
            for at in range(0, len(w), SHORT):
                part = w[at : at + SHORT]
                parts.setdefault(len(part), []).append((part, k))
        for length, members in parts.items():
            for start in range(0, len(members), 20_000):
                own = members[start : start + 20_000]
                spans = list(self.spans([p for p, _ in own]))
                forward, backward = np.zeros((length + 2, len(own))), np.zeros((length + 2, len(own)))
                forward[0] = backward[-1] = 1.0
                # equal weights: a piece counts as one, an unknown character as a thousandth
                chance = np.array([1.0, 1e-3])
                for begin, end, rows, ids in spans:
                    forward[end, rows] += forward[begin, rows] * chance[(ids == self.unknown).astype(int)] * 0.1
                for begin, end, rows, ids in reversed(spans):
                    backward[begin, rows] += backward[end, rows] * chance[(ids == self.unknown).astype(int)] * 0.1
                times = weights[[k for _, k in own]]
                ids = np.concatenate([s[3] for s in spans])
                rows = np.concatenate([s[2] for s in spans])
                share = np.concatenate([forward[b, r] * backward[e, r] * chance[(i == self.unknown).astype(int)] * 0.1 for b, e, r, i in spans]) / forward[-1][rows]
                for lang in range(weights.shape[1]):
                    total[:, lang] += np.bincount(ids, weights=share * times[rows, lang], minlength=self.size)
        return total


@lru_cache(maxsize=2)
def vocabulary(model_path: str) -> Vocabulary:
    return Vocabulary(model_path)


class LanguageModel:
    """Languages and their piece probabilities. ``chances`` is pieces by languages: bounded by the vocabulary."""

    def __init__(self, model_path: str, languages: list[str], counts: np.ndarray):
        self.model_path, self.languages = model_path, languages
        smooth = counts + SMOOTHING
        self.chances = smooth / smooth.sum(axis=0) if languages else smooth
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(languages)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": np.zeros((0, len(self.languages)))}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The best language and its posterior (all languages alike before) for each text."""
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.known) > CACHED:
            self.known, self.table = {}, np.zeros((0, len(self.languages)))
        new = list({w for words in split for w in words if w not in self.known})
        if new and self.languages:
            self.table = np.concatenate([self.table, vocabulary(self.model_path).scores(new, self.chances)])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        names, scores = [], np.zeros(len(texts))
        for k, (text, words) in enumerate(zip(texts, split)):
            lettered = bool(words) and (any(map(str.isalpha, words)) or any(map(str.isalpha, text)))
            if not lettered or not self.languages:
                names.append("und")
                continue
            total = self.table[[self.known[w] for w in words]].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages[best])
            scores[k] = 1.0 / np.exp(total - total[best]).sum()
        return names, scores


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def learn(docs: DataFrame, model_path: str, text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """A model from every row of ``docs`` with a language and a text.

    Tasks add up word counts per language, turn them into expected piece counts and send one row per piece and
    language they saw; the driver receives at most vocabulary x languages sums. Ties between languages go to the first
    name; no labelled row gives a model without languages, which answers ``und``.
    """
    rows = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        total = np.zeros((own.size, len(languages)))
        known: dict[str, int] = {}
        tally = np.zeros(0)

        def settle() -> None:
            nonlocal total, tally
            if known:
                total = total + own.expected(list(known), tally.reshape(-1, len(languages))[: len(known)])
            known.clear()
            tally = np.zeros(0)

        for batch in pieces_of(batches, 2_000_000):
            ids: list[int] = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, words = place[lang], WORD.findall(text.lower())
                for w in set(words):
                    if w not in known:
                        known[w] = len(known)
                ids += [known[w] * len(languages) + at for w in words]
            counted = np.bincount(np.array(ids, dtype=np.int64), minlength=len(known) * len(languages)).astype(float)
            counted[: len(tally)] += tally
            tally = counted
            if len(known) > CACHED:
                settle()
        settle()
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    counts = np.zeros((vocabulary(model_path).size, len(languages)))
    summed = rows.mapInArrow(count, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
    for r in summed.toArrow().to_pylist():
        counts[r["piece"], r["lang"]] = round(r["n"], 6)
    return LanguageModel(model_path, languages, counts)


def predicted(model: LanguageModel, text: str | Column) -> Column:
    """A struct column ``lang_pred, score`` from the whole text alone; null or letterless texts are ``und`` with 0."""

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = [], []
            at, values = 0, texts.tolist()
            while at < len(values):
                stop, chars = at, 0
                while stop < len(values) and (stop == at or chars < 2_000_000):
                    chars += len(values[stop] or "")
                    stop += 1
                own, found = model.predict(values[at:stop])
                names += own
                scores += found.tolist()
                at = stop
            yield pd.DataFrame({"lang_pred": names, "score": np.array(scores, dtype=float)})

    return predict(F.col(text) if isinstance(text, str) else text)
