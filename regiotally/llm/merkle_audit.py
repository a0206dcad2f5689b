"""Fixity audit of replicated web archives with Merkle trees.

A leaf is one record: its offset, length and SHA-256. Leaves that begin in the same range of offsets form a node of
level 1, ``FANOUT`` neighbouring nodes form a node of the next level, up to one root. Offsets are part of what is
hashed, so order counts. Roots of two replicas are compared, then only the children of nodes that differ, and at last
the records of the ranges that differ.

Range hashes are plain sums: they guard against damage, not against forgery. A range may hold any number of leaves if a replica is damaged, so its hash adds up the leaves' hashes (four words of 60
bits) and needs no list; nodes above hash the ordered hashes of at most ``FANOUT`` children.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from regiotally.llm.rows import text_or_empty, written

RANGE = 1 << 20
FANOUT = 16


def record_text(url: Column, body: Column) -> Column:
    """A WARC resource record: header lines, the payload, and the closing blank lines. Nulls count as empty."""
    payload = text_or_empty(body)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        text_or_empty(url),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
        payload,
        F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame, key: str, url_column: str = "url", body_column: str = "html", carried=()) -> DataFrame:
    """``key, offset, length, digest`` of every record, in the order of ``key`` (nulls first; ties by digest).

    Columns of ``carried`` stay beside their record: what an index tells of it, or what a replica holds in its place.

    Narrow rows are range-partitioned and written; the offset is the sum of the slices before (one number each) and a
    running sum inside the slice. Repeated records are records of their own.
    """
    text = record_text(F.col(url_column), F.col(body_column))
    rows = records.select(F.col(key).alias("key"), F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("digest"), *carried).withColumn("n", F.monotonically_increasing_id())
    count = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = written(rows.repartitionByRange(count, "key", "digest", "n").withColumn("slice", F.spark_partition_id()), "leaves")
    totals = sliced.groupBy("slice").agg(F.sum("length").alias("whole"))
    before = totals.select("slice", F.coalesce(F.sum("whole").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row per slice
    running = F.sum("length").over(Window.partitionBy("slice").orderBy("key", "digest", "n").rowsBetween(Window.unboundedPreceding, 0))
    placed = sliced.withColumn("run", running).join(before, "slice")
    return placed.select("key", (F.col("base") + F.col("run") - F.col("length")).alias("offset"), "length", "digest", *carried)


@dataclass(frozen=True)
class Tree:
    """levels[0] has a row per record, the last one a single row: ``node, digest``."""

    leaves: DataFrame
    levels: list[DataFrame]


def tree(rows: DataFrame, width: int = RANGE, fanout: int = FANOUT) -> Tree:
    """The tree over leaves ``key, offset, length, digest``; every level is written. No leaf gives a tree without levels."""
    held = written(rows.withColumn("node", F.floor(F.col("offset") / width).cast("long")), "audit-leaves")
    leaf = F.sha2(F.concat_ws("|", "offset", "length", "digest").cast("binary"), 256)
    words = [F.sum(F.conv(F.substring("leaf", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"w{k}") for k in range(4)]
    ranges = held.select("node", leaf.alias("leaf")).groupBy("node").agg(F.count(F.lit(1)).alias("n"), *words)
    level = written(ranges.select("node", F.sha2(F.concat_ws(":", "n", "w0", "w1", "w2", "w3").cast("binary"), 256).alias("digest")), "audit-level")
    levels = [level]
    while (top := level.agg(F.max("node")).first()[0]) is not None and top > 0:
        children = level.groupBy(F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("own"))
        joined = F.array_join(F.transform("own", lambda c: F.concat_ws("=", c["node"].cast("string"), c["digest"])), "|")
        level = written(children.select(F.col("parent").alias("node"), F.sha2(joined.cast("binary"), 256).alias("digest")), "audit-level")
        levels.append(level)
    return Tree(held, levels)


def _differing(own: DataFrame, other: DataFrame) -> DataFrame:
    """Nodes whose digests differ or that one side lacks."""
    both = own.select("node", F.col("digest").alias("a")).join(other.select("node", F.col("digest").alias("b")), "node", "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")


def damage(own: Tree, other: Tree, fanout: int = FANOUT) -> DataFrame:
    """Where ``other`` differs from ``own``: ``key, offset, length, status``.

    status: ``changed`` (another digest or length at the offset), ``missing`` or ``extra`` (a record that only ``other``
    has, with its own key and length). Equal roots end the audit at once. Trees of unequal height are compared from the
    lower root on.
    """
    height = min(len(own.levels), len(other.levels)) - 1
    suspects = written(_differing(own.levels[height], other.levels[height]), "suspects")
    for k in range(height - 1, -1, -1):
        if suspects.isEmpty():
            break
        parent = F.floor(F.col("node") / fanout).cast("long")
        below = [t.levels[k].join(suspects.select(F.col("node").alias("parent")), parent == F.col("parent"), "left_semi") for t in (own, other)]
        suspects = written(_differing(*below), "suspects")
    mine, theirs = (t.leaves.join(suspects, "node", "left_semi").groupBy("offset", "length", "digest", "key").agg(F.count(F.lit(1)).alias("n")) for t in (own, other))
    sides = mine.join(theirs.select("offset", *[F.col(c).alias(f"{c}_") for c in ("length", "digest", "key", "n")]), "offset", "full")
    same = F.col("digest").eqNullSafe(F.col("digest_")) & F.col("length").eqNullSafe(F.col("length_")) & F.col("n").eqNullSafe(F.col("n_"))
    status = F.when(F.col("digest_").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return sides.filter(~same).select(
        F.when(F.col("digest").isNull(), F.col("key_")).otherwise(F.col("key")).alias("key"), "offset", F.coalesce("length", "length_").alias("length"), status.alias("status")
    )
