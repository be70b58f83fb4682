"""Spreadsheets (SRC-4): a Python data source over Office Open XML and OpenDocument workbooks, and their readable text.

``register(spark)``, then ``spark.read.format("spreadsheet").load(path)``: rows (path, sheet_no, sheet, row, cells). A sheet
with any cell gives a row 0 without cells, then its rows that hold something, cells trimmed and empty ones left out; row
numbers are those of the sheet. Values are as stored: numbers in their shortest form, dates as serial numbers, formulas by
their last result, errors as nothing.

A task reads one sheet, as a stream: a row and, in the first format, the workbook's table of shared strings are all that it
holds. Planning opens each file for its list of sheets; with ``split=file`` it only lists the folder, and a task reads all
sheets of a file. Files are opened where they are, by any address that Arrow knows. A file that can't be read is named in
the error. Folders are read whole, other kinds of files in them are passed over; no file is an empty table.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, sheet_no int, sheet string, row long, cells array<string>"
KINDS = (".xlsx", ".xlsm", ".ods")
# Fixed value: how a sheet is headed in the text.
HEADING = "[시트: %s]"

Row = tuple[int, list[str]]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _elements(stream: BinaryIO, ends: set[str], starts: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, ElementTree.Element]]:
    """(event, local name, element) at the end of some elements, and at the start of others; what was given is let go."""
    stack: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(stream, events=("start", "end")):
        name = _local(e.tag)
        if event == "start":
            stack.append(e)
            if name in starts:
                yield "start", name, e
            continue
        stack.pop()
        if name in ends:
            yield "end", name, e
            e.clear()
            if stack:
                stack[-1].remove(e)


def number(text: str) -> str:
    """A stored number in its shortest form; whole ones without a point up to 21 digits."""
    try:
        x = float(text)
    except ValueError:
        return text
    if x == int(x) and abs(x) < 1e21 if x - x == 0 else False:
        return str(int(x))
    return re.sub(r"e([+-])0+", r"e\1", repr(x))


def _text(e: ElementTree.Element, name: str = "t", skip: str = "rPh") -> str:
    """The text of an element, without its phonetic hints."""
    if _local(e.tag) == name:
        return e.text or ""
    return "".join(_text(c, name, skip) for c in e if _local(c.tag) != skip)


class OfficeOpen:
    def __init__(self, book: zipfile.ZipFile):
        self.book = book
        with book.open("xl/_rels/workbook.xml.rels") as f:
            targets = {e.get("Id"): e.get("Target", "") for _, _, e in _copied(f, "Relationship")}
        with book.open("xl/workbook.xml") as f:
            sheets = [(e.get("name", ""), targets.get(_attribute(e, "id"), "")) for _, _, e in _copied(f, "sheet")]
        # Charts and dialogs are sheets without rows, kept elsewhere.
        self.parts = [(n, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for n, t in sheets]
        self.names = [n for n, _ in self.parts]

    def strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.book.namelist():
            return []
        with self.book.open("xl/sharedStrings.xml") as f:
            return [_text(e) for _, _, e in _elements(f, {"si"})]

    def rows(self, sheet: int) -> Iterator[Row]:
        part = self.parts[sheet][1]
        if "worksheets/" not in part:
            return
        strings, at = self.strings(), 0
        with self.book.open(part) as f:
            for _, _, e in _elements(f, {"row"}):
                at = int(e.get("r") or at + 1)
                yield at, [self.value(c, strings) for c in e if _local(c.tag) == "c"]

    @staticmethod
    def value(c: ElementTree.Element, strings: list[str]) -> str:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return _text(c)
        v = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
        if kind == "s":
            return strings[int(v)] if v.strip() else ""
        return {"b": "true" if v.strip() == "1" else "false", "e": "", "n": number(v)}.get(kind, v)


class OpenDocument:
    def __init__(self, book: zipfile.ZipFile):
        self.book = book
        with book.open("content.xml") as f:
            self.names = [_attribute(e, "name") or "" for event, _, e in _elements(f, {"table-row"}, frozenset({"table"})) if event == "start"]

    def rows(self, sheet: int) -> Iterator[Row]:
        now, at = -1, 0
        with self.book.open("content.xml") as f:
            for event, _, e in _elements(f, {"table-row"}, frozenset({"table"})):
                if event == "start":
                    now += 1
                    if now > sheet:
                        return
                elif now == sheet:
                    cells = [x for c in e if _local(c.tag) in ("table-cell", "covered-table-cell") for x in self.values(c)]
                    times = int(_attribute(e, "number-rows-repeated") or 1)
                    filled = any(x.strip() for x in cells)
                    for k in range(times if filled else 1):
                        yield at + k + 1, cells
                    at += times

    @staticmethod
    def values(c: ElementTree.Element) -> list[str]:
        kind = _attribute(c, "value-type")
        if kind in ("float", "percentage", "currency"):
            v = number(_attribute(c, "value") or "")
        elif kind == "boolean":
            v = _attribute(c, "boolean-value") or ""
        else:
            v = "\n".join(_paragraph(p) for p in c if _local(p.tag) == "p")
        # The empty rest of a row is one cell that is repeated thousands of times.
        return [v] * (int(_attribute(c, "number-columns-repeated") or 1) if v.strip() else 1)


def _paragraph(p: ElementTree.Element) -> str:
    inner = {"s": lambda x: " " * int(_attribute(x, "c") or 1), "tab": lambda x: "\t", "line-break": lambda x: "\n"}
    return (p.text or "") + "".join(inner.get(_local(x.tag), _paragraph)(x) + (x.tail or "") for x in p)


def _copied(f: BinaryIO, name: str) -> list[tuple[str, str, ElementTree.Element]]:
    """The small elements of a directory, whole."""
    return [("end", name, e) for e in ElementTree.parse(f).iter() if _local(e.tag) == name]


def _opened(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(where)


def _book(f, path: str) -> OfficeOpen | OpenDocument:
    return (OpenDocument if path.lower().endswith(".ods") else OfficeOpen)(zipfile.ZipFile(f))


class Unreadable(ValueError):
    def __init__(self, path: str, cause: Exception):
        super().__init__(f"cannot read the spreadsheet {path}: {type(cause).__name__}: {cause}")


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: int | None  # None: all


class Reader(DataSourceReader):
    def __init__(self, path: str, split: str):
        self.path, self.split = path, split

    def files(self) -> list[str]:
        from pyarrow import fs

        remote = "://" in self.path or self.path.startswith("file:")
        system, where = fs.FileSystem.from_uri(self.path) if remote else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(where)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(where, recursive=True))
        head = self.path[: self.path.index(where)] if remote and where in self.path else ""
        return sorted(head + x.path for x in found if x.is_file and x.path.lower().endswith(KINDS))

    def partitions(self) -> list[Sheet]:
        if self.split == "file":
            return [Sheet(p, None) for p in self.files()]
        out = []
        for path in self.files():
            try:
                with _opened(path) as f:
                    out += [Sheet(path, k) for k in range(len(_book(f, path).names))]
            except Exception as e:
                raise Unreadable(path, e) from e
        return out

    def read(self, part: Sheet) -> Iterator[tuple]:
        if part is None:  # a folder without spreadsheets
            return
        try:
            with _opened(part.path) as f:
                book = _book(f, part.path)
                for k in range(len(book.names)) if part.sheet is None else [part.sheet]:
                    yield from self.sheet(part.path, book, k)
        except Exception as e:
            raise Unreadable(part.path, e) from e

    @staticmethod
    def sheet(path: str, book: OfficeOpen | OpenDocument, k: int) -> Iterator[tuple]:
        headed = False
        for at, cells in book.rows(k):
            if cells and not headed:
                headed = True
                yield path, k, book.names[k], 0, []
            filled = [x for c in cells if (x := c.strip())]
            if filled:
                yield path, k, book.names[k], at, filled


class Spreadsheets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spreadsheet"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        split = self.options.get("split", "sheet")
        if split not in ("sheet", "file"):
            raise ValueError("split is sheet or file")
        return Reader(self.options["path"], split)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Spreadsheets)


def read_spreadsheets(spark: SparkSession, path: str, split: str = "sheet") -> DataFrame:
    register(spark)
    return spark.read.format("spreadsheet").option("split", split).load(path)


def text(rows: DataFrame) -> DataFrame:
    """(path, text): a heading for each sheet with any cell, then its rows, joined by tabs; a file's text is one value."""
    line = F.when(F.col("row") == 0, F.format_string(HEADING, "sheet")).otherwise(F.array_join("cells", "\t"))
    lines = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("sheet_no", "row", line.alias("line")))).alias("lines"))
    return lines.select("path", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
