"""Global row positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from regiotally.sources.staging import shared_folder

#: Low bits of a row id that Spark counts up inside a partition; the partition's number is above them.
_LOCAL_BITS = 33


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder of the session (``spark.checkpoint.dir``) and cut off from its lineage.

    Spark removes the files with the DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on. Only a
    session on one machine gets a folder of its own where none is set.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def sliced(df: DataFrame, order, slices: int) -> DataFrame:
    """The rows in ``slices`` ranges of ``order`` (column names, nulls first), with ``_slice`` and ``_place`` (from 0) in it.

    A range exchange finds the boundaries in a sample of the keys and places a row by binary search. The ranges are
    checkpointed, as another run of the exchange would draw another sample; a lost task finds its range again.
    """
    number = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    return checkpointed(
        ranged.withColumn("_number", number).withColumns(
            {"_slice": F.shiftright("_number", _LOCAL_BITS).cast("int"), "_place": F.col("_number").bitwiseAND((1 << _LOCAL_BITS) - 1)}
        ).drop("_number")
    )


def with_position(df: DataFrame, order, name: str = "position", slices: int | None = None) -> tuple[DataFrame, int]:
    """The rows numbered from 1 in ascending ``order`` (column names, nulls first), and their count.

    Rows fall into sorted ranges, are numbered there and shifted by the counts of the ranges before, which are summed up
    over one row per range. End ``order`` with a unique key: ties then have one place, and a value that many rows share
    still spreads over ranges. ``df`` is read twice: for the sample and for the exchange.
    """
    wanted = slices or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = sliced(df, order, wanted)
    counts = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy().orderBy("_slice")) - F.col("_n")  # one row per range
    shifts = counts.select(F.col("_slice").alias("_range"), before.alias("_before"))
    placed = rows.join(shifts, F.col("_slice") == F.col("_range"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    position = (F.col("_place") + F.col("_before") + 1).alias(name)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], position), total


def fold_block(position, rows: int, folds: int):
    """Block of a row under expanding-window validation.

    The first rows form block 0 and the rest ``folds`` blocks of ``rows // (folds + 1)``; fold k trains on
    the blocks before k and is tested on block k.
    """
    size = rows // (folds + 1)
    if size == 0:
        raise ValueError(f"{rows} rows are too few for {folds} folds")
    start = rows - folds * size
    past = F.ceil((F.col(position) - start) / size)
    return F.greatest(past, F.lit(0)).cast("int")
