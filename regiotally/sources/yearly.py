"""One table out of yearly files, with the year that the file's name tells."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from regiotally.sources.delimited import read_delimited

#: The last four digits in a row of a path are its year.
YEAR = r".*(?<!\d)(\d{4})(?!\d)"


def matching(spark: SparkSession, pattern: str) -> dict[str, str]:
    """Files or folders that a glob matches, in order, with their place on the file system; one per year, so they are few."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(conf).globStatus(place)
    paths = [f.getPath() for f in found or []]
    return dict(sorted((str(p.toString()), str(p.toUri().getPath())) for p in paths))


def read_yearly(spark: SparkSession, pattern: str, schema: StructType, year_column: str = "file_year", kind: str = "delimited") -> DataFrame:
    """All files or folders that ``pattern`` matches as one scan, with the year of the path a row was read from.

    The columns of every path are compared with ``schema`` before: a path without one of them, with a column of another
    type (Parquet), without a year, or of a year that another one has fails with its name. ``kind`` is ``delimited`` (a headed text
    file, all headers alike) or ``parquet`` (further columns are left out). Rows keep their year when files move to
    other folders, as the last four digits of the path decide.
    """
    paths = matching(spark, pattern)
    if not paths:
        raise ValueError(f"nothing matches {pattern}")
    years: dict[int, str] = {}
    for path in paths:
        told = re.match(YEAR, path)
        if not told:
            raise ValueError(f"{path} tells no year")
        if int(told[1]) in years:
            raise ValueError(f"{path} and {years[int(told[1])]} are of one year")
        years[int(told[1])] = path
    if kind == "parquet":
        for path in paths:
            _compare(path, spark.read.parquet(path).schema, schema)
        rows = spark.read.schema(schema).parquet(*paths).withColumn("_path", F.col("_metadata.file_path"))
    else:
        rows = read_delimited(spark, list(paths), schema, keep_path=True)
    # the year is that of the matched path: a part file inside it may have digits of its own
    place = F.url_decode(F.replace(F.parse_url("_path", F.lit("PATH")), F.lit("+"), F.lit("%2B")))
    within = F.lit(None).cast("int")
    for year, path in years.items():
        here = (place == paths[path]) | F.startswith(place, F.lit(f"{paths[path].rstrip('/')}/"))
        within = F.when(here, year).otherwise(within)
    return rows.withColumn(year_column, within).select(*[f.name for f in schema], year_column)


def _compare(path: str, found: StructType, wanted: StructType) -> None:
    held = {f.name: f.dataType for f in found}
    for field in wanted:
        if field.name not in held:
            raise ValueError(f"{path} has no column {field.name}")
        if held[field.name] != field.dataType:
            raise ValueError(f"{path} has {field.name} as {held[field.name].simpleString()}, not {field.dataType.simpleString()}")
