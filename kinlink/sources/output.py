"""Written workbooks, released only as a whole: ``df.write.format("workbook_output").mode("append").save()``.

Each row of the frame is one change or one demand: (original, output, sheet, row, col, value,
kind).  The rows of an output must stand in one partition (:func:`released`).  A task copies the
original, applies the changes, compares the copy with the original part by part, and leaves it
beside its output under a name of its own.  Only when every workbook of the job has passed does the
driver's commit move them into place, by renames; when one fails, abort deletes what was left, and no
output appears.  A task that is tried again or runs twice leaves another copy, and only the one that
Spark commits is moved.

kind: ``write`` sets a value (null empties the cell); ``link`` also sets or removes the cell's
hyperlink, by the first address of the value; ``fill`` takes away a cell's fill and nothing else;
``header`` and ``link_header`` set a new column's title, styled like the column ``like`` where there is
one, and give a link column room; ``check`` changes nothing, the cell must hold the value.
"""

from __future__ import annotations

import copy
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .workbook import _M, _R, WorkbookError, _check, _text, column_letters, column_number, sheets

CHANGES = "original string, output string, sheet string, row int, col int, value string, kind string, like int"
#: How a link looks, and the width of a new link column.
LINK_COLOUR, LINK_WIDTH = "FF0563C1", 48
_PR = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Ignorable"
# what may follow the links in a sheet's part
_AFTER = ["printOptions", "pageMargins", "pageSetup", "headerFooter", "rowBreaks", "colBreaks", "customProperties", "cellWatches", "ignoredErrors", "smartTags", "drawing", "legacyDrawing", "legacyDrawingHF", "drawingHF", "picture", "oleObjects", "controls", "webPublishItems", "tableParts", "extLst"]


def _m(name: str) -> str:
    return f"{_M}{name}"


def place(ref: str) -> tuple[int, int]:
    letters, row = re.match(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    return int(row), column_number(letters)


def _spans(ref: str) -> tuple[tuple[int, int], tuple[int, int]]:
    a, b = (ref + ":" + ref).split(":")[:2]
    return place(a), place(b)


def first_address(text: str | None) -> str | None:
    first = text.splitlines()[0].split(" ")[0] if text and text.splitlines() else ""
    return first if first.startswith("https://") else None


def _parsed(xml: bytes) -> ElementTree.Element:
    """A part's root; its name spaces keep their names when it is written."""
    from io import BytesIO

    root = None
    for event, x in ElementTree.iterparse(BytesIO(xml), events=("start-ns", "start")):
        if event == "start-ns" and not re.fullmatch(r"ns\d+", x[0]):
            ElementTree.register_namespace(*x)
        elif root is None and event == "start":
            root = x
    root.attrib.pop(_MC, None)  # it may name prefixes that nothing uses
    return root


def _bytes(root: ElementTree.Element) -> bytes:
    return ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")


class Styles:
    """The cell formats of a workbook, by the numbers that cells carry."""

    def __init__(self, xml: bytes | None) -> None:
        self.changed = False
        self.root = _parsed(xml) if xml else None
        self.formats = self._list("cellXfs")

    def _list(self, name: str) -> list[ElementTree.Element]:
        found = self.root.find(_m(name)) if self.root is not None else None
        return list(found) if found is not None else []

    def _add(self, name: str, node: ElementTree.Element) -> int:
        parent = self.root.find(_m(name))
        parent.append(node)
        parent.set("count", str(len(parent)))
        self.changed = True
        return len(parent) - 1

    def fill(self, style: int) -> tuple[str | None, str | None]:
        """(type, colour) of a format's fill."""
        fills = self._list("fills")
        at = int(self.formats[style].get("fillId", 0)) if style < len(self.formats) else 0
        pattern = fills[at].find(_m("patternFill")) if at < len(fills) else None
        if pattern is None:
            return None, None
        front = pattern.find(_m("fgColor"))
        return pattern.get("patternType"), front.get("rgb") if front is not None else None

    def signature(self, style: int, with_fill: bool = True) -> tuple:
        """What a format looks like; equal for equal looks in different workbooks."""
        if style >= len(self.formats):
            return ()
        f = self.formats[style]
        shown = lambda name, key: ElementTree.tostring(x[int(f.get(key, 0))]).strip() if int(f.get(key, 0)) < len(x := self._list(name)) else None
        number = int(f.get("numFmtId", 0))
        code = next((n.get("formatCode") for n in self._list("numFmts") if int(n.get("numFmtId")) == number), number)
        parts = [ElementTree.tostring(x).strip() if (x := f.find(_m(name))) is not None else None for name in ("alignment", "protection")]
        return (code, shown("fonts", "fontId"), shown("fills", "fillId") if with_fill else None, shown("borders", "borderId"), *parts)

    def _variant(self, style: int, change) -> int:
        node = copy.deepcopy(self.formats[style])
        change(node)
        text = ElementTree.tostring(node).strip()
        for k, other in enumerate(self.formats):
            if ElementTree.tostring(other).strip() == text:
                return k
        at = self._add("cellXfs", node)
        self.formats = self._list("cellXfs")
        return at

    def without_fill(self, style: int) -> int:
        def change(node: ElementTree.Element) -> None:
            node.set("fillId", "0")
            node.attrib.pop("applyFill", None)

        return self._variant(style, change) if style < len(self.formats) else style

    def as_link(self, style: int) -> int:
        if style >= len(self.formats):
            return style
        font = ElementTree.fromstring(f'<font xmlns="{_M[1:-1]}"><u /><color rgb="{LINK_COLOUR}" /></font>')
        fonts = [ElementTree.tostring(x).strip() for x in self._list("fonts")]
        text = ElementTree.tostring(font).strip()
        at = fonts.index(text) if text in fonts else self._add("fonts", font)

        def change(node: ElementTree.Element) -> None:
            node.set("fontId", str(at))
            node.set("applyFont", "1")
            node.set("applyAlignment", "1")
            for old in node.findall(_m("alignment")):
                node.remove(old)
            node.insert(0, ElementTree.Element(_m("alignment"), {"vertical": "top", "wrapText": "1"}))

        return self._variant(style, change)


@dataclass
class Cell:
    value: str | None
    style: int


class Sheet:
    """A sheet's part as it is compared and changed."""

    def __init__(self, xml: bytes, links: bytes | None) -> None:
        self.root = _parsed(xml)
        self.relations = _parsed(links) if links else None
        self.links_changed = False
        data = self.root.find(_m("sheetData"))
        self.lines = {int(line.get("r")): line for line in data} if data is not None else {}

    def node(self, row: int, col: int, create: bool = False) -> ElementTree.Element | None:
        line = self.lines.get(row)
        ref = f"{column_letters(col)}{row}"
        if line is None:
            if not create:
                return None
            data = self.root.find(_m("sheetData"))
            line = self.lines[row] = ElementTree.SubElement(data, _m("row"), {"r": str(row)})
            data[:] = [self.lines[r] for r in sorted(self.lines)]
        found = next((c for c in line if c.get("r") == ref), None)
        if found is None and create:
            found = ElementTree.SubElement(line, _m("c"), {"r": ref})
            line[:] = sorted(line, key=lambda c: place(c.get("r"))[1])
        return found

    def cells(self, shared: list[str]) -> dict[tuple[int, int], Cell]:
        out = {}
        for line in self.lines.values():
            for c in line:
                kind, v = c.get("t"), c.find(_m("v"))
                f = c.find(_m("f"))
                value = _text(c.find(_m("is"))) if kind == "inlineStr" else v.text if v is not None else None
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                if f is not None:  # a formula is what the cell holds, whatever it last came to
                    value = "=" + (f.text or "")
                out[place(c.get("r"))] = Cell(value, int(c.get("s", 0)))
        return out

    def links(self) -> dict[tuple[int, int], str | None]:
        targets = {r.get("Id"): r.get("Target") for r in self.relations} if self.relations is not None else {}
        held = self.root.find(_m("hyperlinks"))
        return {place(h.get("ref")): targets.get(h.get(f"{_R}id"), h.get("location")) for h in (held if held is not None else [])}

    def texts(self, name: str, key: str) -> list[str]:
        return sorted(x.get(key) for x in self.root.iter(_m(name)))

    def shape(self) -> dict[str, object]:
        """What must stay as it is, by the name of its check."""
        pane = next(iter(self.root.iter(_m("pane"))), None)
        widths = {k: c.get("width") for c in self.root.iter(_m("col")) for k in range(int(c.get("min")), int(c.get("max")) + 1)}
        return {
            "merged_cells": self.texts("mergeCell", "ref"), "freeze_panes": (pane.get("topLeftCell"), pane.get("state")) if pane is not None else None, "auto_filter": self.texts("autoFilter", "ref"), "column_widths": widths,
            "conditional_formatting": len(list(self.root.iter(_m("conditionalFormatting")))), "data_validations": len(list(self.root.iter(_m("dataValidation")))),
        }

    def inside_merged(self, row: int, col: int) -> bool:
        return any(a[0] <= row <= b[0] and a[1] <= col <= b[1] and (row, col) != a for a, b in map(_spans, self.texts("mergeCell", "ref")))

    def set_value(self, row: int, col: int, value: str | None) -> None:
        if self.inside_merged(row, col):
            raise WorkbookError(f"cell {column_letters(col)}{row} is inside a merged range")
        if value is not None and value.startswith("="):
            raise WorkbookError(f"refusing to write a value like a formula into {column_letters(col)}{row}")
        node = self.node(row, col, value is not None)
        if node is None:
            return
        for child in list(node):
            node.remove(child)
        node.attrib.pop("t", None)
        if value is not None:
            node.set("t", "inlineStr")
            text = ElementTree.SubElement(ElementTree.SubElement(node, _m("is")), _m("t"))
            text.text = value
            text.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")

    def set_link(self, row: int, col: int, address: str | None) -> None:
        ref = f"{column_letters(col)}{row}"
        held = self.root.find(_m("hyperlinks"))
        for old in [h for h in (held if held is not None else []) if place(h.get("ref")) == (row, col)]:
            held.remove(old)
        if address is not None:
            if self.relations is None:
                self.relations = ElementTree.Element(f"{_PR}Relationships")
            name = f"rIdLink{uuid.uuid4().hex[:12]}"
            ElementTree.SubElement(self.relations, f"{_PR}Relationship", {"Id": name, "Type": _LINK, "Target": address, "TargetMode": "External"})
            self.links_changed = True
            if held is None:
                held = ElementTree.Element(_m("hyperlinks"))
                after = next((k for k, x in enumerate(self.root) if x.tag in {_m(n) for n in _AFTER}), len(self.root))
                self.root.insert(after, held)
            ElementTree.SubElement(held, _m("hyperlink"), {"ref": ref, f"{_R}id": name})
        if held is not None and not len(held):
            self.root.remove(held)

    def set_width(self, col: int, width: int) -> None:
        if col in self.shape()["column_widths"]:
            return
        columns = self.root.find(_m("cols"))
        if columns is None:
            columns = ElementTree.Element(_m("cols"))
            self.root.insert(list(self.root).index(self.root.find(_m("sheetData"))), columns)
        ElementTree.SubElement(columns, _m("col"), {"min": str(col), "max": str(col), "width": str(width), "customWidth": "1"})
        columns[:] = sorted(columns, key=lambda c: int(c.get("min")))


class Book:
    """A workbook that is open."""

    def __init__(self, path: str) -> None:
        _check(path)
        self.zip = zipfile.ZipFile(path)
        self.names = self.zip.namelist()
        self.sheets = {title: part for title, part, _ in sheets(self.zip)}
        self.styles = Styles(self.part("xl/styles.xml"))
        shared = self.part("xl/sharedStrings.xml")
        self.shared = [_text(x) for x in ElementTree.fromstring(shared).iter(_m("si"))] if shared else []

    def part(self, name: str) -> bytes | None:
        return self.zip.read(name) if name in self.names else None

    @staticmethod
    def relations(part: str) -> str:
        folder, name = part.rsplit("/", 1)
        return f"{folder}/_rels/{name}.rels"

    def sheet(self, title: str) -> Sheet:
        if title not in self.sheets:
            raise WorkbookError(f"missing sheet {title!r}")
        part = self.sheets[title]
        return Sheet(self.zip.read(part), self.part(self.relations(part)))

    def __enter__(self) -> Book:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()


def write_changed(original: str, path: str, changes: list[dict]) -> None:
    """A copy of ``original`` at ``path`` with the changes."""
    with Book(original) as book, zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        new: dict[str, bytes] = {}
        for title in dict.fromkeys(c["sheet"] for c in changes):
            sheet = book.sheet(title)
            for c in (c for c in changes if c["sheet"] == title and c["kind"] != "check"):
                row, col, kind = c["row"], c["col"], c["kind"]
                if kind == "fill":
                    node = sheet.node(row, col)
                    if node is not None:
                        node.set("s", str(book.styles.without_fill(int(node.get("s", 0)))))
                    continue
                sheet.set_value(row, col, c["value"])
                if kind == "link":
                    address = first_address(c["value"])
                    sheet.set_link(row, col, address)
                    if address is not None:
                        node = sheet.node(row, col)
                        node.set("s", str(book.styles.as_link(int(node.get("s", 0)))))
                elif kind in ("header", "link_header"):
                    like = sheet.node(row, c["like"]) if c["like"] else None
                    if like is not None and like.get("s"):
                        sheet.node(row, col).set("s", like.get("s"))
                    if kind == "link_header":
                        sheet.set_width(col, LINK_WIDTH)
                elif kind != "write":
                    raise WorkbookError(f"unknown kind of change {kind!r}")
            part = book.sheets[title]
            new[part] = _bytes(sheet.root)
            if sheet.links_changed:
                new[Book.relations(part)] = _bytes(sheet.relations)
        if book.styles.changed:
            new["xl/styles.xml"] = _bytes(book.styles.root)
        for name in [*book.names, *(n for n in new if n not in book.names)]:
            out.writestr(book.zip.getinfo(name) if name in book.names else name, new.get(name) if name in new else book.zip.read(name))


def compared(original: str, output: str, changes: list[dict]) -> list[tuple[str, bool, str]]:
    """(check, ok, detail): whether ``output`` is ``original`` with the changes and nothing else."""
    out: list[tuple[str, bool, str]] = []
    try:
        with zipfile.ZipFile(output) as z:
            bad = z.testzip()
        out.append(("zip_integrity", bad is None, bad or ""))
        new = Book(output)
    except (OSError, ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return [*out, ("workbook_opens", False, f"{type(e).__name__}: {e}")]
    with new, Book(original) as old:
        out.append(("workbook_opens", True, ""))
        out.append(("sheet_names_and_order", list(old.sheets) == list(new.sheets), ", ".join(new.sheets)))
        if not out[-1][1]:
            return out
        touched = {old.sheets[t] for t in {c["sheet"] for c in changes} if t in old.sheets}
        may = touched | {Book.relations(p) for p in touched} | {"xl/styles.xml"}
        others = [n for n in sorted({*old.names, *new.names} - may) if old.part(n) != new.part(n)]
        out.append(("other_parts", not others, ", ".join(others[:5])))
        for title in old.sheets:
            out += _compared_sheet(title, old, new, [c for c in changes if c["sheet"] == title])
    return out


def _compared_sheet(title: str, old: Book, new: Book, changes: list[dict]) -> Iterator[tuple[str, bool, str]]:
    a, b = old.sheet(title), new.sheet(title)
    before, after, links_before, links_after = a.cells(old.shared), b.cells(new.shared), a.links(), b.links()
    by = {(c["row"], c["col"]): c for c in changes if c["kind"] not in ("fill", "check")}
    bare = {(c["row"], c["col"]) for c in changes if c["kind"] == "fill"}
    filled = lambda cells: [p for p, c in cells.items() if c.value is not None]
    wanted = [*filled(before), *(p for p, c in by.items() if c["value"] is not None)]
    most = lambda places: (max((p[0] for p in places), default=0), max((p[1] for p in places), default=0))
    gone = {p for p, c in by.items() if c["value"] is None}
    yield f"dimensions[{title}]", most(filled(after)) == most([p for p in wanted if p not in gone]), str(most(filled(after)))
    shape, now = a.shape(), b.shape()
    for name in shape:
        same = {k: v for k, v in now[name].items() if k in shape[name]} == shape[name] if name == "column_widths" else now[name] == shape[name]
        yield f"{name}[{title}]", same, str(now[name])[:200]
    wrong, links, looks = [], [], []
    none = Cell(None, 0)
    for p in sorted({*before, *after, *by, *links_before, *links_after}):
        x, y = before.get(p, none), after.get(p, none)
        if y.value != (by[p]["value"] if p in by else x.value):
            wrong.append(f"{column_letters(p[1])}{p[0]}: {y.value!r}")
        address = first_address(by[p]["value"]) if p in by and by[p]["kind"] == "link" else links_before.get(p)
        if links_after.get(p) != address:
            links.append(f"{column_letters(p[1])}{p[0]}: {links_after.get(p)!r}")
        if p in bare:
            ok = new.styles.fill(y.style)[0] in (None, "none") and old.styles.signature(x.style, False) == new.styles.signature(y.style, False)
        else:  # a link has a look of its own, and so has a cell that had none
            ok = (p in by and (by[p]["kind"] == "link" or x.style == 0)) or old.styles.signature(x.style) == new.styles.signature(y.style)
        if not ok:
            looks.append(f"{column_letters(p[1])}{p[0]}")
    yield f"cell_values[{title}]", not wrong, f"{len(wrong)} differ: " + "; ".join(wrong[:50])
    yield f"cell_formatting[{title}]", not looks, f"{len(looks)} differ: " + "; ".join(looks[:50])
    yield f"hyperlinks[{title}]", not links, f"{len(links)} differ: " + "; ".join(links[:50])
    held = lambda p: (after.get(p, none).value or "").strip() or None
    moved = [c["row"] for c in changes if c["kind"] == "check" and held((c["row"], c["col"])) != c["value"]]
    yield f"row_identity[{title}]", not moved, f"rows {moved[:10]}" if moved else ""


@dataclass
class Staged(WriterCommitMessage):
    """What a task has left: (its copy, where it is to go)."""

    files: list[tuple[str, str]]


class GateError(RuntimeError):
    pass


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def write(self, iterator: Iterator) -> Staged:
        by: dict[tuple[str, str], list[dict]] = {}
        for row in iterator:
            r = row.asDict()
            by.setdefault((r["original"], r["output"]), []).append({"like": None, **r, "kind": r.get("kind") or "write"})
        staged: list[tuple[str, str]] = []
        try:
            for (original, output), changes in by.items():
                places = [(c["sheet"], c["row"], c["col"], c["kind"] == "check") for c in changes]
                if len(set(places)) < len(places):
                    raise GateError(f"{output}: two changes of one cell")
                folder, name = os.path.split(os.path.abspath(output))
                path = os.path.join(folder, f".{uuid.uuid4().hex}-{name}")
                staged.append((path, output))
                write_changed(original, path, changes)
                failed = [f"{check}: {detail}" for check, ok, detail in compared(original, path, changes) if not ok]
                if failed:
                    raise GateError(f"output verification failed, {output} was not released. " + "; ".join(failed)[:2000])
        except BaseException:
            _removed(staged)
            raise
        return Staged(staged)

    def commit(self, messages: list) -> None:
        outputs = [output for m in messages if m for _, output in m.files]
        if len(set(outputs)) < len(outputs):
            self.abort(messages)
            raise GateError("the rows of an output stand in several partitions; use released()")
        for m in messages:
            for path, output in m.files if m else []:
                os.replace(path, output)

    def abort(self, messages: list) -> None:
        for m in messages:
            _removed(m.files if m else [])


def _removed(files: list[tuple[str, str]]) -> None:
    for path, _ in files:
        if os.path.exists(path):
            os.unlink(path)


class WorkbookOutput(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook_output"

    def schema(self) -> str:
        return CHANGES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookOutput)


def released(changes: DataFrame) -> None:
    """Writes all workbooks of ``changes``, or none. A workbook has a bounded number of rows, so its changes fit in a task."""
    register(changes.sparkSession)
    changes.repartition("output").sortWithinPartitions("output", "sheet", F.col("row"), F.col("col")).write.format("workbook_output").mode("append").save()
