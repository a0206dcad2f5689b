"""Small helpers that the operators share: shared folders, row batches and text keys."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BATCH_ROWS = 1_000
#: Used only where ``spark.checkpoint.dir`` is unset, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this library's folder on the path of its Python workers, wherever they are started.

    Batches that go to the workers are held to ``BATCH_ROWS`` rows, as whole texts differ much in length.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root, own = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    parts = [p for p in own.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        own["PYTHONPATH"] = os.pathsep.join([*parts, root])
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return LOCAL_CHECKPOINTS


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/llm/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: several readers, no lineage, no lost blocks."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces_of(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one piece holds about ``chars`` bytes; a single longer row stays whole.

    At the end Arrow's unused memory goes back, as a worker lives on for the stages after.
    """
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * chars / max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)
    pa.default_memory_pool().release_unused()


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` bears."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
