"""Headed text files in, headed text or Parquet files out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Texts that count as missing when a headed file is read.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)


def trimmed_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_delimited(
    spark: SparkSession, path, schema: StructType, missing=MISSING, multi_line: bool = False, keep_path: bool = False
) -> DataFrame:
    """Read headed text; columns are found by trimmed name and cast to the declared types.

    Only one header is looked at up front; a file with another header fails the job, as does a value that does not
    fit its type. With ``multi_line`` quoted values may hold line breaks; a file is then read by one task. With
    ``keep_path`` a column ``_path`` tells the file of a row.
    """
    text = _text(spark, path, schema, multi_line, keep_path)
    columns = [_known(field.name, missing).cast(field.dataType).alias(field.name) for field in schema]
    return text.select(*columns, *(["_path"] if keep_path else []))


def read_with_rejects(
    spark: SparkSession, path, schema: StructType, missing=MISSING, multi_line: bool = False, required=()
) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and the lines that are none: ``line, file, reason``. Every line is in exactly one of the two.

    A line is rejected for too few or too many values, for a value that does not fit its type, or for a missing value of
    a ``required`` column; the first reason in that order, and by column order, is told. Lines keep the text they have in
    the file; a row with a line break inside quotes is one only with ``multi_line``. Both tables read the files when they are
    used, so persist them where both are.
    """
    text = _text(spark, path, schema, multi_line, keep_path=True, corrupt=True)
    reasons = [F.when(F.col("_broken").isNotNull(), F.lit("number of values"))]
    for field in schema:
        value = _known(field.name, missing)
        reasons.append(F.when(value.isNotNull() & value.try_cast(field.dataType).isNull(), F.lit(f"type of {field.name}")))
    reasons += [F.when(_known(n, missing).isNull(), F.lit(f"missing {n}")) for n in required]
    judged = text.withColumn("_reason", F.coalesce(*reasons))
    clean = judged.filter("_reason is null").select(*[_known(f.name, missing).try_cast(f.dataType).alias(f.name) for f in schema])
    own = [c for c in text.columns if c not in ("_broken", "_path")]
    line = F.coalesce("_broken", F.to_csv(F.struct(*[F.col(f"`{c}`") for c in own])))
    return clean, judged.filter("_reason is not null").select(line.alias("line"), F.col("_path").alias("file"), F.col("_reason").alias("reason"))


def _known(name: str, missing) -> Column:
    value = F.col(f"`{name}`")
    return F.when(~value.isin(*missing), value)


def _text(spark: SparkSession, path, schema: StructType, multi_line: bool, keep_path: bool, corrupt: bool = False) -> DataFrame:
    """All columns as text under trimmed names; ``_broken`` is the line where its number of values is wrong."""
    read = spark.read.option("header", True).option("multiLine", multi_line)
    names = read.csv(path).columns
    kinds = StructType([StructField(n, StringType()) for n in names])
    if corrupt:
        kinds, read = kinds.add("_broken", StringType()), read.option("columnNameOfCorruptRecord", "_broken")
    # every header is compared as a whole, so no column may be left out before
    text = read.schema(kinds).option("enforceSchema", False).option("columnPruning", False).csv(path)
    if keep_path:
        text = text.withColumn("_path", F.col("_metadata.file_path"))
    text = trimmed_header(text)
    absent = [f.name for f in schema if f.name not in text.columns]
    if absent:
        raise ValueError(f"{path} has no column {absent}")
    return text


def write_delimited(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write headed text, one file per task: the table is never gathered in one place."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by=(), mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_summaries(summaries: dict[str, DataFrame], folder: str, mode: str = "error") -> list[str]:
    """Write the table behind each figure to its own folder and return the paths."""
    paths = []
    for name, table in summaries.items():
        paths.append(f"{folder.rstrip('/')}/{name}")
        write_delimited(table, paths[-1], mode)
    return paths
