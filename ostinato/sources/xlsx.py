"""First sheet of an Excel workbook as text columns.

A sheet holds at most 1,048,576 rows, so one task reads one workbook.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ET.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        first = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")[0].get(_REL)
        target = next(
            r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == first
        )
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        rows = []
        for row in ET.fromstring(book.read(part)).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for place, cell in enumerate(row.findall(f"{_MAIN}c")):
                at = _column(cell.get("r")) if cell.get("r") else place
                value = cell.find(f"{_MAIN}v")
                if cell.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is None or value.text is None:
                    cells[at] = None
                elif cell.get("t") == "s":
                    cells[at] = shared[int(value.text)]
                else:
                    cells[at] = value.text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Header row and data rows of the first sheet; every column is text."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                cells = sheet_rows(content)
                yield pd.DataFrame({"at": range(len(cells)), "cells": cells})

    raw = spark.read.format("binaryFile").load(str(path)).select("content")
    table = raw.mapInPandas(rows, "at int, cells array<string>")
    header = table.where(F.col("at") == 0).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    names = [c for c in header.cells]
    return table.where(F.col("at") > 0).select(
        *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names) if n]
    )
