"""Headed text, workbooks and sinks."""

import datetime
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from regiotally.sources.delimited import read_delimited, write_delimited, write_parquet, write_summaries
from regiotally.sources.workbook import read_workbooks

SCHEMA = StructType(
    [
        StructField("Quarter Ending", DateType()),
        StructField("Region", StringType()),
        StructField("Total PAC", DoubleType()),
        StructField("Cask", LongType()),
    ]
)


def test_headers_are_trimmed_and_columns_found_by_name(spark, tmp_path):
    (tmp_path / "in.csv").write_text(" Region ,Cask, Total PAC,Quarter Ending,unused\nDarwin,3,1.5,2024-03-31,x\nNA,,,,\n")
    got = [tuple(r) for r in read_delimited(spark, str(tmp_path / "in.csv"), SCHEMA).collect()]
    assert got == [(datetime.date(2024, 3, 31), "Darwin", 1.5, 3), (None, None, None, None)]


def test_another_header_fails_and_line_breaks_are_kept(spark, tmp_path):
    part = StructType([SCHEMA["Region"], SCHEMA["Cask"]])
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("Region,Cask\nDarwin,1\n")
    (tmp_path / "two" / "b.csv").write_text("Cask,Region\n2,Katherine\n")
    with pytest.raises(Exception, match="does not conform"):
        read_delimited(spark, str(tmp_path / "two"), part).collect()
    (tmp_path / "broken.csv").write_text('Region,Cask\n"Alice\nSprings",4\n#NA,5\n')
    got = read_delimited(spark, str(tmp_path / "broken.csv"), part, multi_line=True).collect()
    assert [tuple(r) for r in got] == [("Alice\nSprings", 4), (None, 5)]


def test_missing_column_and_bad_value_fail(spark, tmp_path):
    (tmp_path / "short.csv").write_text("Region\nDarwin\n")
    with pytest.raises(ValueError, match="no column"):
        read_delimited(spark, str(tmp_path / "short.csv"), SCHEMA)
    (tmp_path / "bad.csv").write_text("Region,Cask\nDarwin,many\n")
    part = StructType([SCHEMA["Region"], SCHEMA["Cask"]])
    with pytest.raises(PySparkException):
        read_delimited(spark, str(tmp_path / "bad.csv"), part).collect()


def test_written_text_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("A", True), ("B", False)], "`Region` string, `Region_B` boolean")
    write_delimited(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == df.columns
    assert sorted(tuple(r) for r in back.collect()) == [("A", "true"), ("B", "false")]
    write_parquet(df, str(tmp_path / "parts"), ["Region"])
    assert (tmp_path / "parts" / "Region=A").is_dir()
    paths = write_summaries({"one": df, "two": df.limit(1)}, str(tmp_path / "tables"))
    assert [spark.read.option("header", True).csv(p).count() for p in paths] == [2, 1]


def workbook(path, sheets):
    """A minimal workbook; texts are shared, numbers and dates are plain cells."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    texts = []

    def cell(reference, value):
        if value is None:
            return f'<c r="{reference}" s="1"/>'
        if isinstance(value, str):
            texts.append(value)
            return f'<c r="{reference}" t="s"><v>{len(texts) - 1}</v></c>'
        return f'<c r="{reference}"><v>{value}</v></c>'

    with zipfile.ZipFile(path, "w") as archive:
        listed, links = "", ""
        for k, (name, rows) in enumerate(sheets.items(), 1):
            body = "".join(
                f'<row r="{i}">' + "".join(cell(f"{chr(65 + j)}{i}", v) for j, v in enumerate(row)) + "</row>"
                for i, row in enumerate(rows, 1)
            )
            archive.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
            listed += f'<sheet name="{name}" sheetId="{k}" r:id="rId{k}"/>'
            links += f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>'
        archive.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        archive.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
        )
        shared = "".join(f"<si><r><t>{t}</t></r></si>" for t in texts)
        archive.writestr("xl/sharedStrings.xml", f"<sst {main}>{shared}</sst>")


def test_workbooks(spark, tmp_path):
    header = ["Quarter Ending", " Region", "Total PAC", "Cask"]
    workbook(tmp_path / "y2024.xlsx", {"Notes": [["text"]], "Data": [header, [45382, "Darwin", 10.5, 3], [45382, None, None, 4]]})
    workbook(tmp_path / "y2025.xlsx", {"Data": [header[:3], ["2025-03-31", "Katherine", 7]]})
    got = read_workbooks(spark, [str(tmp_path / "y2024.xlsx"), str(tmp_path / "y2025.xlsx")], SCHEMA, "Data")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(
        [
            (datetime.date(2024, 3, 31), "Darwin", 10.5, 3),
            (datetime.date(2024, 3, 31), None, None, 4),
            (datetime.date(2025, 3, 31), "Katherine", 7.0, None),
        ],
        key=repr,
    )
    notes = StructType([StructField("text", StringType())])
    assert read_workbooks(spark, str(tmp_path / "y2024.xlsx"), notes).count() == 0
    with pytest.raises(PySparkException, match="no sheet"):
        read_workbooks(spark, str(tmp_path / "y2025.xlsx"), SCHEMA, "Missing").collect()
