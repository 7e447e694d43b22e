"""Workbooks (.xlsx, .xlsm) as a Spark data source: ``spark.read.format("workbook").load(path)`` gives cells.

Files are parsed by the standard library, one file a task.  The writer keeps the
original file as it is and only changes the cells that are written; it puts the
new file in place by a rename.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import CELL

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class WorkbookError(ValueError):
    pass


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _check(path: str) -> None:
    ending = os.path.splitext(path)[1].lower()
    if ending == ".xls":
        raise WorkbookError("legacy .xls files are not supported; save the file as .xlsx")
    if ending not in (".xlsx", ".xlsm"):
        raise WorkbookError(f"unsupported file type {ending!r}")
    if not zipfile.is_zipfile(path):
        raise WorkbookError("not a valid workbook")


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str, bool]]:
    """(title, part, visible) of each sheet."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_M}sheet"):
        target = targets[s.get(f"{_R}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}", s.get("state", "visible") == "visible"))
    return out


def _text(node: ElementTree.Element | None) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_M}t")) if node is not None else ""


def read_cells(path: str) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of the visible sheets' cells that hold something; a hidden only sheet is read."""
    _check(path)
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_M}si")]
        every = sheets(book)
        for title, part, visible in every:
            if not visible and len(every) > 1:
                continue
            with book.open(part) as f:
                for _, cell in ElementTree.iterparse(f):
                    if cell.tag != f"{_M}c":
                        continue
                    value, kind = cell.find(f"{_M}v"), cell.get("t")
                    text = _text(cell.find(f"{_M}is")) if kind == "inlineStr" else (value.text if value is not None else None)
                    if text is not None:
                        letters, row = re.match(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                        if kind == "s":
                            text = shared[int(text)]
                        elif kind == "b":
                            text = "TRUE" if text == "1" else "FALSE"
                        yield title, int(row), column_number(letters), text
                    cell.clear()


def read_styled_cells(path: str) -> Iterator[tuple[str, int, int, str | None, str | None, str | None, str | None]]:
    """(sheet, row, col, value, fill_type, fill, link) of the visible sheets' cells that hold or look like something."""
    from .output import Book

    _check(path)
    with Book(path) as book:
        every = sheets(book.zip)
        for title, _, visible in every:
            if not visible and len(every) > 1:
                continue
            sheet = book.sheet(title)
            links = sheet.links()
            for (row, col), cell in sheet.cells(book.shared).items():
                yield (title, row, col, cell.value, *book.styles.fill(cell.style), links.get((row, col)))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.styled = options.get("styles", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_styled_cells(partition.value) if self.styled else read_cells(partition.value)


class WorkbookSource(DataSource):
    """Options: path (several with commas between); styles: true adds fill_type, fill and link to each cell."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELL + (", fill_type string, fill string, link string" if self.options.get("styles", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def write_cells(original: str, output: str, expected: DataFrame) -> None:
    """A copy of ``original`` with the expected cells (sheet, row, col, value)."""
    write_workbooks(expected.select(F.lit(original).alias("original"), F.lit(output).alias("output"), "sheet", "row", "col", "value")).collect()


def write_workbooks(expected: DataFrame) -> DataFrame:
    """(output, n_cells) of the workbooks that are written when this is read: each in a task of its own, to a folder that all tasks share.

    expected: (original, output, sheet, row, col, value).  A workbook has a bounded number of rows, so its cells fit in a task.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        changes: dict[str, dict[tuple[int, int], str | None]] = {}
        for sheet, row, col, value in zip(group["sheet"], group["row"], group["col"], group["value"], strict=True):
            changes.setdefault(sheet, {})[int(row), int(col)] = value
        original, output = group["original"].iloc[0], group["output"].iloc[0]
        _write(original, output, changes)
        return pd.DataFrame({"output": [output], "n_cells": [len(group)]})

    return expected.groupBy("original", "output").applyInPandas(run, "output string, n_cells long")


def _write(original: str, output: str, changes: dict[str, dict[tuple[int, int], str | None]]) -> None:
    _check(original)
    handle, path = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(output)), suffix=os.path.splitext(output)[1])
    os.close(handle)
    try:
        with zipfile.ZipFile(original) as book, zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            parts = {part: changes[title] for title, part, _ in sheets(book) if title in changes}
            if len(parts) < len(changes):
                raise WorkbookError(f"missing sheet among {sorted(changes)}")
            for name in book.namelist():
                out.writestr(book.getinfo(name), _changed(book.read(name), parts[name]) if name in parts else book.read(name))
        os.replace(path, output)
    finally:
        if os.path.exists(path):
            os.unlink(path)


def _changed(xml: bytes, cells: dict[tuple[int, int], str | None]) -> bytes:
    ElementTree.register_namespace("", _M[1:-1])
    root = ElementTree.fromstring(xml)
    for merged in root.iter(f"{_M}mergeCell"):
        a, b = (re.match(r"([A-Z]+)(\d+)", x).groups() for x in (merged.get("ref") + ":" + merged.get("ref")).split(":")[:2])
        for row, col in cells:
            if int(a[1]) <= row <= int(b[1]) and column_number(a[0]) <= col <= column_number(b[0]) and (row, col) != (int(a[1]), column_number(a[0])):
                raise WorkbookError(f"cell {column_letters(col)}{row} is inside a merged range")
    data = root.find(f"{_M}sheetData")
    lines = {int(r.get("r")): r for r in data}
    for row in sorted({r for r, _ in cells} - set(lines)):
        lines[row] = ElementTree.SubElement(data, f"{_M}row", {"r": str(row)})
    data[:] = [lines[r] for r in sorted(lines)]
    for (row, col), value in cells.items():
        ref, line = f"{column_letters(col)}{row}", lines[row]
        cell = next((c for c in line if c.get("r") == ref), None)
        if cell is None:
            if value is None:
                continue
            cell = ElementTree.SubElement(line, f"{_M}c", {"r": ref})
            line[:] = sorted(line, key=lambda c: column_number(re.match("[A-Z]+", c.get("r")).group()))
        for child in list(cell):
            cell.remove(child)
        cell.attrib.pop("t", None)
        if value is not None:
            cell.set("t", "inlineStr")
            ElementTree.SubElement(ElementTree.SubElement(cell, f"{_M}is"), f"{_M}t").text = value
    return ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")
