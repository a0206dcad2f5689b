"""Quality rules: text statistics, and an ordered list of threshold rules learned from labelled documents.

Sequential covering: a rule grows by the threshold with the largest information gain on the growing part until it
covers no good document there, is then cut back to the prefix that does best on the pruning part, and is kept if it is
precise enough on both; the documents it covers leave both parts and the next rule is learned. The rules become one
Spark conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from regiotally.llm.pseudonyms import bound
from regiotally.llm.rows import text_or_empty, written

BLANK = r"[\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def covered(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(own: Column) -> Column:
            again = F.transform(
                F.sequence(F.lit(1), F.size(own)),
                lambda j: F.when(
                    (F.get(own, j - 2)["g"] == F.get(own, j - 1)["g"]) | (F.get(own, j)["g"] == F.get(own, j - 1)["g"]),
                    F.get(own, j - 1)["i"],
                ),
            )
            return F.array_sort(F.filter(again, lambda x: x.isNotNull()))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            bound(ordered, places),
            start,
            lambda a, p: F.struct((p + window).alias("end"), (a["n"] + p + window - F.greatest(p, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    def counted(own: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(own) - window), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(window)])
        )
        return bound(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    return F.when(F.size(words) > window, bound(hashes, counted)).otherwise(F.lit(0))


def statistics(text: Column) -> Column:
    """A struct of whole-text counts; a null text has none of anything."""
    text = text_or_empty(text)
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return bound(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(text, F.lit(r"\p{P}")).cast("long").alias("n_marks"),
        ),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


#: Measures of a document that the rules compare with thresholds.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "words": lambda s: s["n_words"].cast("double"),
    "word_length": lambda s: s["word_chars"] / F.greatest(s["n_words"], F.lit(1)),
    "symbols_per_word": lambda s: s["n_symbols"] / F.greatest(s["n_words"], F.lit(1)),
    "duplicate_lines_per_word": lambda s: s["n_dup_lines"] / F.greatest(s["n_words"], F.lit(1)),
    "repeated_share": lambda s: s["n_repeat_words"] / F.greatest(s["n_words"], F.lit(1)),
    "upper_per_character": lambda s: s["n_upper"] / F.greatest(s["word_chars"], F.lit(1)),
    "marks_per_word": lambda s: s["n_marks"] / F.greatest(s["n_words"], F.lit(1)),
}


@dataclass(frozen=True)
class Condition:
    measure: str
    at_least: bool
    threshold: float

    def holds(self, value: Column) -> Column:
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order: a document that one of them covers is rejected."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejects(self, s: Column) -> Column:
        """One conditional expression over a struct of ``statistics``."""
        verdict = F.lit(False)
        for rule in reversed(self.rules):
            met = F.lit(True)
            for c in rule:
                met = met & c.holds(MEASURES[c.measure](s))
            verdict = F.when(met, F.lit(True)).otherwise(verdict)
        return verdict


@dataclass(frozen=True)
class Learning:
    """``most_rows`` bounds the labelled rows that are used (by a hash of their id); ``cuts`` the thresholds of a measure."""

    most_rows: int = 20_000
    cuts: int = 40
    most_conditions: int = 3
    most_rules: int = 8
    precision: float = 0.95
    least_covered: int = 3


def learn(docs: DataFrame, labels: DataFrame, settings: Learning = Learning(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DecisionList:
    """Rules for the documents labelled 0 among those that pass the base rules.

    Labels without an id or a value are left out, contradicting labels of an id count as the lower one. Without bad
    labels the list is empty and rejects nothing. Ties between thresholds go to the first in the order of ``MEASURES``.
    """
    spark = docs.sparkSession
    known = labels.groupBy(F.col(id_column).alias("_id")).agg(F.min(F.col(label_column).cast("int")).alias("_good")).filter("_id IS NOT NULL AND _good IS NOT NULL")
    share = min(1.0, settings.most_rows / max(1, known.count()))
    # at most about most_rows rows, whatever the table holds: small enough to send to every task
    sample = F.broadcast(known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    own = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(sample, "_id")
    counted = own.select("_good", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(3)).alias("_fold"), statistics(F.col("_text")).alias("s"))
    rows = written(counted.filter(~base_failed(F.col("s"))).select("_good", "_fold", *[m(F.col("s")).alias(n) for n, m in MEASURES.items()]), "labelled")
    quantiles = [k / settings.cuts for k in range(settings.cuts)]
    found = rows.agg(*[F.percentile_approx(n, quantiles, 10_000).alias(n) for n in MEASURES]).first()
    tails = rows.filter("_good = 0").agg(*[F.percentile_approx(n, quantiles, 10_000).alias(n) for n in MEASURES]).first()
    cuts = {n: sorted({*(found[n] or []), *(tails[n] or [])}) for n in MEASURES}

    def bin_of(name: str) -> Column:
        """How many cuts the measure reaches."""
        return F.size(F.filter(F.array(*map(F.lit, cuts[name] or [math.inf])), lambda t: F.col(name) >= t))

    binned = F.array(*map(bin_of, MEASURES))
    table = written(rows.select("_good", (F.col("_fold") < 2).alias("_grow"), binned.alias("_bins")), "binned")
    names, rules, left = list(MEASURES), [], F.lit(True)

    def met(places: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for m, at_least, k in places:
            b = F.col("_bins")[m]
            out = out & ((b >= k) if at_least else (b < k))
        return out

    def histogram(where: Column) -> dict[tuple[int, int], tuple[int, int]]:
        """(measure, bin) -> bad and good rows of the growing part."""
        flat = table.filter(where & F.col("_grow")).select("_good", F.posexplode("_bins").alias("m", "b"))
        return {(r["m"], r["b"]): (r["bad"], r["good"]) for r in flat.groupBy("m", "b").agg(F.count_if(F.col("_good") == 0).alias("bad"), F.count_if(F.col("_good") > 0).alias("good")).collect()}

    def covered(where: Column) -> dict[bool, tuple[int, int]]:
        got = table.filter(where).groupBy("_grow").agg(F.count_if(F.col("_good") == 0).alias("bad"), F.count_if(F.col("_good") > 0).alias("good")).collect()
        return {True: (0, 0), False: (0, 0)} | {r["_grow"]: (r["bad"], r["good"]) for r in got}

    while len(rules) < settings.most_rules:
        places: list[tuple[int, bool, int]] = []
        while len(places) < settings.most_conditions:
            bins = histogram(left & met(places))
            bad, good = (sum(v[k] for (m, _), v in bins.items() if m == 0) for k in (0, 1))
            if bad < settings.least_covered or not good:
                break
            best = None
            for m, name in enumerate(names):
                below = [0, 0]
                for k in range(1, len(cuts[name]) + 1):
                    below = [below[j] + bins.get((m, k - 1), (0, 0))[j] for j in (0, 1)]
                    for at_least, (p, n) in ((True, (bad - below[0], good - below[1])), (False, tuple(below))):
                        if p >= settings.least_covered:
                            gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, (m, at_least, k))
            if best is None or best[0] <= 0:
                break
            places.append(best[1])
        if not places:
            break
        tried = [(p, covered(left & met(places[: p + 1]))) for p in range(len(places))]
        worth = lambda c: (c[False][0] - c[False][1]) / max(1, sum(c[False]))
        cut, counts = max(tried, key=lambda t: (worth(t[1]), -t[0]))
        precise = all(p >= settings.precision * (p + n) for p, n in counts.values())
        if not precise or counts[True][0] < settings.least_covered:
            break
        rules.append(tuple(Condition(names[m], at_least, float(cuts[names[m]][k - 1])) for m, at_least, k in places[: cut + 1]))
        left = left & ~met(places[: cut + 1])
    return DecisionList(tuple(rules))


def judged(docs: DataFrame, rules: DecisionList, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, statistics, ``base_failed`` and ``kept`` of every row of ``docs``; a null text fails the base rules. No shuffle."""
    s = F.col("s")
    counted = docs.select(F.col(id_column), statistics(F.col(text_column).cast("string")).alias("s"))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]
    return counted.select(F.col(id_column), *[s[f].alias(f) for f in fields], base_failed(s).alias("base_failed"), (~base_failed(s) & ~rules.rejects(s)).alias("kept"))
