"""Secret scans: a random forest that tells true findings from look-alikes.

Candidates are long tokens with a digit, and values after a name such as ``token`` or ``password``; a value that a name is
given by any mark (``=``, ``:``, ``:=``, ``=>``) and in any quotes is taken whole up to the next blank, quote, bracket, comma
or semicolon. Their measures are the length, the shares and changes of character classes, how usual their letter pairs
are, how much of them is made of words, what the path says, and the words next to them. Word counts and letter pairs are
learned from all documents. The forest is trained from labelled findings; the sample is bounded. Everything is Spark SQL
and Spark ML.

Without labels only sure findings teach: values given to a name are true unless they are words or the place says that
they are samples; plain numbers, mail addresses, UUIDs and words are false. All others are unknown and are only judged. What
makes a label is none of the measures, so the forest has to judge a value by its looks and its neighbours.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from regiotally.llm.pseudonyms import bound
from regiotally.llm.rows import text_or_empty, written

#: Between tokens; quotes, brackets and assignment marks are no part of a value that no name is given.
BETWEEN = r"[^\p{L}\p{N}+/_.@\x01-]+"
#: Around a value that a name is given.
AROUND = r"[\s\"'`()\[\]{}<>,;|]+"
#: Stands after a name that is given a value.
MARK = "\x01"
CANDIDATE = r"^(?=[^0-9]*[0-9])[\p{L}\p{N}+/_.@-]{16,}$"
SECRETS = r"(?:token|secret|password|passwd|pwd|(?:api|access|secret|private|auth|encryption|signing)[_-]?key|credentials?)"
SIGN = rf"[\p{{L}}\p{{N}}+/_.@-]{{16}}|(?i:{SECRETS})"
NAMES = rf"(?i)^[\p{{L}}\p{{N}}_.@/-]*{SECRETS}$"
GIVEN = rf"(?i)({SECRETS})[\"'`\]]{{0,2}}[ \t]*(?::=|=>|==(?=[ \t])|=|:)[ \t]*"
NUMBER = r"^[0-9.+/_-]+$"
MAIL = r"^[^@]+@[^@]+\.[^@]+$"
UUID = r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"
HARMLESS = r"(?i)test|example|sample|dummy|fixture|mock|placeholder|template|docs?/"
LEAST_LENGTH = 8
#: A word of the dictionary is in at least so many documents.
LEAST_DOCUMENTS = 5
CLASSES = 29  # a-z, digits, anything else; 0 is unused
MEASURES = ["size", "digits", "upper", "lower", "changes", "pairs", "coverage", "harmless_path", "path_depth", "harmless_near", "word_before", "word_after"]
#: A value of this share of dictionary words is none that a program made up.
WORDY = 0.8


@dataclass(frozen=True)
class Forest:
    """``most_rows`` bounds the labelled findings that are used, chosen by a hash of value and place."""

    most_rows: int = 20_000
    trees: int = 20
    depth: int = 6
    least_score: float = 0.5
    seed: int = 11


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """``id, place, value, before2, before, after, path, assigned``: a row per candidate token of the whole text.

    ``place`` is the number of tokens before it. ``assigned``: the text gives the value to a name of a secret.
    Null and empty texts have no candidates; a null path is empty; a value that is there twice is two rows, as is one of a
    repeated row. No shuffle.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), text_or_empty(path_column).cast("string").alias("path"))
    signed = rows.filter(F.col("text").rlike(SIGN))

    def found(words: Column) -> Column:
        def pick(word: Column, i: Column) -> Column:
            near = lambda k: F.replace(F.coalesce(F.get(words, i + k), F.lit("")), F.lit(MARK), F.lit(""))
            given = F.coalesce(F.endswith(F.get(words, i - 1), F.lit(MARK)), F.lit(False))
            bare = F.regexp_replace(F.replace(word, F.lit(MARK), F.lit("")), r"^[._/-]+|[._/-]+$", "")
            value = F.when(given, F.regexp_replace(word, r"[.:]+$", "")).otherwise(bare)
            wanted = value.rlike(CANDIDATE) | ((F.length(value) >= LEAST_LENGTH) & (given | near(-1).rlike(NAMES)))
            return F.when(
                wanted,
                F.struct(i.alias("place"), value.alias("value"), near(-2).alias("before2"), near(-1).alias("before"), near(1).alias("after"), given.alias("assigned")),
            )

        return F.filter(F.transform(words, pick), lambda x: x.isNotNull())

    def tokens(pieces: Column) -> Column:
        """Pieces after a mark stay whole, the others are cut further."""

        def cut(piece: Column, i: Column) -> Column:
            given = F.coalesce(F.endswith(F.get(pieces, i - 1), F.lit(MARK)), F.lit(False))
            return F.when(given, F.array(piece)).otherwise(F.split(piece, BETWEEN))

        return F.filter(F.flatten(F.transform(pieces, cut)), lambda w: w != "")

    marked = F.regexp_replace(F.replace("text", F.lit(MARK), F.lit(" ")), GIVEN, f"$1{MARK} ")
    pieces = F.filter(F.split(marked, AROUND), lambda w: w != "")
    return signed.select("id", "path", F.explode(bound(bound(pieces, tokens), found)).alias("c")).select(
        "id", "c.place", "c.value", "c.before2", "c.before", "c.after", "path", "c.assigned"
    )


def sure_labels() -> Column:
    """1 for values given to a name, 0 for numbers, mail addresses, UUIDs, words and samples, null for all that is unknown.

    A column over ``measured`` candidates.
    """
    plain = F.col("value").rlike(NUMBER) | F.col("value").rlike(MAIL) | F.col("value").rlike(UUID)
    sample = (F.col("harmless_path") > 0) | (F.col("harmless_near") > 0)
    wordy = F.col("coverage") >= WORDY
    return F.when(plain & ~F.col("assigned") | wordy, 0).when(F.col("assigned"), F.when(~sample, 1))


def dictionary(docs: DataFrame, text_column: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``word, n``: lower-case letter runs of 3 to 24 letters and the number of documents that have them."""
    words = F.array_distinct(F.filter(F.split(F.lower(text_or_empty(text_column).cast("string")), r"\P{L}+"), lambda w: F.length(w).between(3, 24)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _class(character: Column) -> Column:
    code = F.ascii(character)
    return F.when(code.between(97, 122), code - 96).when(code.between(48, 57), 27).otherwise(28)


def pair_costs(words: DataFrame) -> list[float]:
    """Log probability of each character class after another one, as a flat table, from the dictionary's words."""
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("p"))
    counted = pairs.groupBy((_class(F.substring("p", 1, 1)) * CLASSES + _class(F.substring("p", 2, 1))).alias("at")).agg(F.sum("n").alias("n")).collect()
    table = [0.5] * (CLASSES * CLASSES)
    for r in counted:  # at most one row per pair of classes
        table[r["at"]] += r["n"]
    return [math.log(table[a * CLASSES + b] / sum(table[a * CLASSES : (a + 1) * CLASSES])) for a in range(CLASSES) for b in range(CLASSES)]


def measured(found: DataFrame, words: DataFrame, costs: list[float]) -> DataFrame:
    """``found`` with a column per measure. Values, runs and words are made distinct before they meet the dictionary."""
    value = F.col("value")
    runs = F.filter(F.split(F.lower(value), r"\P{L}+"), lambda w: F.length(w) >= 3)
    values = found.select("value").distinct()
    parts = values.select("value", F.explode(runs).alias("word"))
    known = parts.join(words.select("word"), "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    table = F.array(*map(F.lit, costs))
    kinds = F.transform(F.split(F.lower(value), ""), _class)
    pairs = bound(
        kinds,
        lambda k: F.aggregate(F.sequence(F.lit(1), F.size(k) - 1), F.lit(0.0), lambda a, i: a + F.element_at(table, F.get(k, i - 1) * CLASSES + F.get(k, i) + 1)) / (F.size(k) - 1),
    )
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / F.length(value)
    by_value = values.join(known, "value", "left").select(
        "value",
        F.length(value).cast("double").alias("size"),
        share("[0-9]").alias("digits"),
        share(r"\p{Lu}").alias("upper"),
        share(r"\p{Ll}").alias("lower"),
        share(r"(?<=[0-9])(?![0-9])|(?<=\p{Lu})(?!\p{Lu})|(?<=\p{Ll})(?!\p{Ll})").alias("changes"),
        F.when(F.length(value) > 1, pairs).otherwise(0.0).alias("pairs"),
        (F.coalesce("covered", F.lit(0)) / F.length(value)).alias("coverage"),
    )
    near = found.select(F.explode(F.array(F.lower("before"), F.lower("after"))).alias("word")).distinct().join(words, "word")
    flag = lambda c: c.cast("double")
    return (
        found.join(by_value, "value")
        .withColumn("_b", F.lower("before"))
        .withColumn("_a", F.lower("after"))
        .join(near.select(F.col("word").alias("_b"), F.log1p("n").alias("word_before")), "_b", "left")
        .join(near.select(F.col("word").alias("_a"), F.log1p("n").alias("word_after")), "_a", "left")
        .drop("_a", "_b")
        .fillna(0.0, ["word_before", "word_after"])
        .withColumn("harmless_path", flag(F.col("path").rlike(HARMLESS)))
        .withColumn("path_depth", F.size(F.split("path", r"[/\\]")).cast("double"))
        .withColumn("named", flag(F.col("before").rlike(NAMES)))
        .withColumn("named_before", flag(F.col("before2").rlike(NAMES)))
        .withColumn("harmless_near", flag(F.concat_ws(" ", "before2", "before", "after").rlike(HARMLESS)))
    )


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=MEASURES, outputCol="features", handleInvalid="keep").transform(rows)


def trained(labelled: DataFrame, settings: Forest = Forest(), label_column: str = "label") -> RandomForestClassificationModel | None:
    """A forest from measured findings with a label of 1 (true) or 0; None if only one kind is there.

    Rows without a label are left out. At most about ``most_rows`` rows are used.
    """
    known = labelled.filter(F.col(label_column).isNotNull())
    share = min(1.0, settings.most_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("value", "id", "place"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = written(chosen.select(*MEASURES, F.col(label_column).cast("double").alias("label")), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed)
    return forest.fit(_assembled(rows))


def scored(rows: DataFrame, model: RandomForestClassificationModel | None, least: float = Forest().least_score) -> DataFrame:
    """``rows`` with ``score`` and ``is_secret``. Without a model a value that follows a name counts as a secret."""
    if model is None:
        return rows.withColumn("score", F.col("named")).withColumn("is_secret", F.col("named") >= least)
    out = model.transform(_assembled(rows)).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("is_secret", F.col("score") >= least).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labels: Column | None = None, settings: Forest = Forest(), id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """Every candidate of every document with its score: ``id, place, value, path, score, is_secret``.

    ``labels`` is a column over ``measured`` candidates that tells true findings (1) from false ones (0, null: unknown);
    without it ``sure_labels`` teaches. Repeated rows repeat their findings, an empty table has none. If only one kind of
    label is there, a value that follows a name counts as a secret.
    """
    found = written(candidates(docs, id_column, text_column, path_column), "candidates")
    words = written(dictionary(docs, text_column), "dictionary")
    rows = written(measured(found, words, pair_costs(words)), "measured")
    label = labels if labels is not None else sure_labels()
    model = trained(rows.withColumn("label", label), settings)
    return scored(rows, model, settings.least_score).select(F.col("id").alias(id_column), "place", "value", "path", "score", "is_secret")
