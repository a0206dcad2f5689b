"""Sheets of spreadsheet workbooks as one DataFrame, each workbook parsed by the task that holds it."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, IntegralType, NumericType, StructType, TimestampType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
EPOCH = datetime.datetime(1899, 12, 30)


def read_workbooks(spark: SparkSession, paths, schema: StructType, sheet: str | None = None) -> DataFrame:
    """Rows of the named sheet (the first one by default) of every workbook under ``paths``.

    Columns are found by trimmed header name; one that a workbook lacks is null. The format bounds a sheet
    at about a million rows, and workbooks spread over tasks.
    """
    files = spark.read.format("binaryFile").load(paths).select("content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield from sheet_frames(bytes(content), schema, sheet)

    return files.mapInPandas(parse, schema)


def sheet_frames(content: bytes, schema: StructType, sheet: str | None, size: int = 10_000) -> Iterator[pd.DataFrame]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        texts = shared_texts(archive)
        header: dict[int, str] | None = None
        rows: list[list] = []
        with archive.open(sheet_member(archive, sheet)) as stream:
            for cells in sheet_rows(stream, texts):
                if header is None:
                    header = {place: str(value).strip() for place, value in cells.items()}
                    continue
                named = {header[place]: value for place, value in cells.items() if place in header}
                rows.append([typed(named.get(f.name), f.dataType) for f in schema])
                if len(rows) == size:
                    yield frame(rows, schema)
                    rows = []
    yield frame(rows, schema)


def frame(rows: list[list], schema: StructType) -> pd.DataFrame:
    return pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(schema)})


def sheet_member(archive: zipfile.ZipFile, sheet: str | None) -> str:
    sheets = ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    found = [s for s in sheets if sheet is None or s.get("name") == sheet]
    if not found:
        raise ValueError(f"no sheet named {sheet}")
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    target = next(link.get("Target") for link in links if link.get("Id") == found[0].get(RELATION))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def shared_texts(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    items = ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in items]


def sheet_rows(stream, texts: list[str]) -> Iterator[dict[int, object]]:
    """Cells of each row by column number, parsed as the file is read."""
    for _, row in ElementTree.iterparse(stream):
        if row.tag != f"{MAIN}row":
            continue
        cells = {}
        for order, cell in enumerate(row.iter(f"{MAIN}c")):
            value = cell_value(cell, texts)
            if value is not None:
                cells[column_number(cell.get("r"), order)] = value
        row.clear()
        if cells:
            yield cells


def cell_value(cell, texts: list[str]):
    kind, value = cell.get("t"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if value is None or value.text is None or kind == "e":
        return None
    return texts[int(value.text)] if kind == "s" else value.text


def column_number(reference: str | None, order: int) -> int:
    if not reference:
        return order
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def typed(value, kind):
    """A cell as a Python value of the declared type; dates may be day numbers or ISO text."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    if isinstance(kind, (DateType, TimestampType)):
        text = str(value).strip()
        moment = (
            EPOCH + datetime.timedelta(days=float(text))
            if re.fullmatch(r"[0-9.]+", text)
            else datetime.datetime.fromisoformat(text)
        )
        return moment.date() if isinstance(kind, DateType) else moment
    if isinstance(kind, IntegralType):
        return int(float(value))
    if isinstance(kind, NumericType):
        return float(value)
    return str(value)
