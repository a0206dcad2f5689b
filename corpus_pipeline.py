"""A pipeline over ``documents``: each stage calls one operator of ``regiotally.llm`` on all that its predecessor kept.

Stages take and return the columns of ``documents``; the last one returns ids and digests. A null text has no language
and goes in the first stage. Extra columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from regiotally.llm import latent_leaks, order_minhash, piece_language, pseudonyms, tree_bpe
from regiotally.llm.queries import KEY
from regiotally.llm.rows import fresh, shared_path, shipped
from regiotally.sources.staging import removed

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language, however sure it is: only null texts and those without a letter go.

    Learns from all documents with a known language.
    """
    shipped(spark)
    model = piece_language.learn(docs, public_tokenizers.path("piece_bpe_32k.model"))
    own = fresh(docs, "_language")
    found = docs.withColumn(own, piece_language.predicted(model, "text"))
    return found.filter(F.col(own)["lang_pred"] != "und").drop(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each class of near duplicates."""
    shipped(spark)
    return order_minhash.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``."""
    return docs.filter(~latent_leaks.leaking(docs, shipped(spark).read.parquet(f"{sf_dir}/benchmark.parquet")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal numbers, dates and addresses by pseudonyms of the same format and length."""
    return pseudonyms.pseudonymise(docs, KEY, count_column=None)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and a check that they decode to its text."""
    shipped(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return tree_bpe.digests(tree_bpe.decode_ids(tree_bpe.encode_texts(docs, ranks, pattern), ranks, pattern))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE encoding and decoding", encoding),
]

#: Segmentations, sketches and latent directions have no SQL form; tests hold each stage to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder, read by the next and then removed.

    The last result stays, as the rows returned are read from it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
