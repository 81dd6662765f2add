"""Reading .xlsx tables with the standard library: a workbook is a zip of XML files."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def rows_of(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as strings; empty cells are null."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                at = _column(c.get("r")) if c.get("r") else k
                v = c.find(f"{_NS}v")
                if c.get("t") == "s" and v is not None:
                    cells[at] = shared[int(v.text)]
                elif c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                else:
                    cells[at] = v.text if v is not None else None
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, its first row the header. A sheet has at most 1,048,576 rows, so one task reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(rows_of(content.as_py()), pa.list_(pa.string()))], names=["cells"])

    sheet = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "cells array<string>")
    head = sheet.first()
    names = [n if n else f"_c{i}" for i, n in enumerate(head[0])] if head else ["_c0"]
    rows = sheet.select("cells", F.monotonically_increasing_id().alias("at")).where("at > 0")  # one task, so that the header is number 0
    return rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
