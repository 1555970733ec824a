"""Workbooks as a Spark data source: spark.read.format("xlsx").option("part", "cells").load(path).

Parts: sheets, cells, names, tables, validations, comments, styles.  Files are listed by Spark's
own reader (any store it can open); each file is a row, read where it lies.  A worksheet's XML
is streamed, so that a sheet's cells are never in memory at once.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridlineage.functions.address import MAX_COL, MAX_ROW
from gridlineage.functions.formula import column_number, shift

# Number formats of dates by their built-in number.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}

SCHEMAS = {
    "sheets": "sheet_id int, sheet_name string, sha256 string",
    "cells": "sheet_id int, row int, col int, a1 string, formula_a1 string, value string, data_type string, style int",
    "names": "name string, scope string, destinations array<string>, is_external boolean, is_dynamic boolean",
    "tables": "sheet_id int, name string, ref string, header_rows int, totals_rows int, columns array<string>",
    "validations": "sheet_id int, sqref string, type string, formula1 string, formula2 string, choices array<string>",
    "comments": "sheet_id int, a1 string, author string, text string, thread_order int",
    "styles": "style int, code string, is_date boolean, is_percent boolean, parens boolean, unit string, is_1904 boolean",
}


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(root: ET.Element, name: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if _name(e.tag) == name)


def _text(e: ET.Element) -> str:
    """Text of a string item; rich runs are joined, phonetic ones left out."""
    if any(_name(c.tag) == "r" for c in e):
        return "".join(t.text or "" for r in e if _name(r.tag) == "r" for t in r if _name(t.tag) == "t")
    return "".join(t.text or "" for t in e if _name(t.tag) == "t")


class Workbook:
    """An open workbook; sheets are numbered from 1 in their order, chart sheets left out."""

    def __init__(self, data: bytes):
        self.data, self.zip = data, zipfile.ZipFile(io.BytesIO(data))
        self.files = set(self.zip.namelist())
        self.book = self._xml("xl/workbook.xml")
        rels = self._relations("xl/workbook.xml")
        self.sheets: list[tuple[int, str, str]] = []
        self.tabs = [s.attrib["name"] for s in _all(self.book, "sheet")]  # chart sheets too: scopes count them
        for s in _all(self.book, "sheet"):
            path = rels.get(next((v for k, v in s.attrib.items() if _name(k) == "id"), ""), ("", ""))
            if path[0].endswith("/worksheet"):
                self.sheets.append((len(self.sheets) + 1, s.attrib["name"], path[1]))
        if len({n.lower() for _, n, _ in self.sheets}) < len(self.sheets):
            raise ValueError("two sheets have the same name")

    def _xml(self, path: str) -> ET.Element:
        return ET.fromstring(self.zip.read(path))

    def _relations(self, path: str) -> dict[str, tuple[str, str]]:
        """Id -> (type, path) of a part's relations."""
        folder, file = posixpath.split(path)
        rels = f"{folder}/_rels/{file}.rels"
        if rels not in self.files:
            return {}
        full = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}")
        return {r.attrib["Id"]: (r.attrib["Type"], full(r.attrib["Target"])) for r in _all(self._xml(rels), "Relationship") if r.attrib.get("TargetMode") != "External"}

    def _related(self, path: str, kind: str) -> list[ET.Element]:
        return [self._xml(p) for t, p in self._relations(path).values() if t.endswith(f"/{kind}") and p in self.files]

    def part(self, name: str) -> Iterator[tuple]:
        return getattr(self, f"_{name}")()

    def _sheets(self) -> Iterator[tuple]:
        sha = hashlib.sha256(self.data).hexdigest()
        yield from ((k, n, sha) for k, n, _ in self.sheets)

    def _cells(self) -> Iterator[tuple]:
        strings = [_text(e) for e in _all(self._xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in self.files else []
        for number, _, path in self.sheets:
            masters: dict[str, tuple[str, int, int]] = {}
            with self.zip.open(path) as f:
                for _, e in ET.iterparse(f):
                    if _name(e.tag) != "c":
                        if _name(e.tag) == "row":
                            e.clear()
                        continue
                    formula = value = None
                    shared = None
                    for c in e:
                        tag = _name(c.tag)
                        if tag == "f":
                            formula = c.text
                            shared = c.attrib.get("si") if c.attrib.get("t") == "shared" else None
                        elif tag == "v":
                            value = c.text
                        elif tag == "is":
                            value = _text(c)
                    m = re.fullmatch(r"([A-Z]+)([0-9]+)", e.attrib["r"])
                    row, col = int(m[2]), column_number(m[1])
                    if row > MAX_ROW or col > MAX_COL:
                        raise ValueError(f"{e.attrib['r']} is out of the sheet")
                    if shared is not None:
                        if formula:
                            masters[shared] = (formula, row, col)
                        elif shared in masters:
                            base, r, c = masters[shared]
                            formula = shift(base, row - r, col - c)
                    kind = e.attrib.get("t", "n")
                    if kind == "s" and value is not None:
                        value = strings[int(value)]
                    if formula is not None or value is not None:
                        yield number, row, col, e.attrib["r"], formula and "=" + formula, value, kind, int(e.attrib.get("s", 0))

    def _names(self) -> Iterator[tuple]:
        for n in _all(self.book, "definedName"):
            text = (n.text or "").strip()
            local = n.attrib.get("localSheetId")
            scope = self.tabs[int(local)] if local is not None and int(local) < len(self.tabs) else None
            parts = [p.strip() for p in re.findall(r"(?:'(?:[^']|'')*'|[^,'(]|\([^)]*\))+", text)]
            external = "[" in text.split("!")[0]
            dynamic = "(" in re.sub(r"'(?:[^']|'')*'", "", text) or "!" not in text
            yield n.attrib["name"], scope, parts, external, dynamic

    def _tables(self) -> Iterator[tuple]:
        for number, _, path in self.sheets:
            for x in self._related(path, "table"):
                yield number, x.attrib.get("displayName", x.attrib.get("name")), x.attrib["ref"], int(x.attrib.get("headerRowCount", 1)), int(x.attrib.get("totalsRowCount", 0)), [c.attrib["name"] for c in _all(x, "tableColumn")]

    def _validations(self) -> Iterator[tuple]:
        for number, _, path in self.sheets:
            for v in _all(self._xml(path), "dataValidation"):
                one = {_name(c.tag): "".join(c.itertext()).strip() for c in v}
                first = one.get("formula1")
                choices = [x.strip() for x in first[1:-1].split(",")] if first and re.fullmatch('"[^"]*"', first) else None
                yield number, v.attrib.get("sqref", one.get("sqref")), v.attrib.get("type"), first, one.get("formula2"), choices

    def _comments(self) -> Iterator[tuple]:
        people = {p.attrib.get("id"): p.attrib.get("displayName") for f in sorted(self.files) if f.startswith("xl/persons/") for p in _all(self._xml(f), "person")}
        for number, _, path in self.sheets:
            threads: dict[str, list] = {}
            for x in self._related(path, "threadedComment"):
                for c in _all(x, "threadedComment"):
                    text = next(("".join(t.itertext()) for t in c if _name(t.tag) == "text"), "")
                    threads.setdefault(c.attrib["ref"], []).append((c.attrib.get("dT", ""), people.get(c.attrib.get("personId")), text))
            for a1, said in threads.items():
                for k, (_, who, text) in enumerate(sorted(said, key=lambda s: s[0])):
                    yield number, a1, who, text, k
            for x in self._related(path, "comments"):
                authors = [a.text for a in _all(x, "author")]
                for c in _all(x, "comment"):
                    if c.attrib["ref"] not in threads:  # else it mirrors a thread
                        yield number, c.attrib["ref"], authors[int(c.attrib.get("authorId", 0))] if authors else None, "".join(t.text or "" for t in _all(c, "t")), 0

    def _styles(self) -> Iterator[tuple]:
        is_1904 = any(p.attrib.get("date1904") in ("1", "true") for p in _all(self.book, "workbookPr"))
        if "xl/styles.xml" not in self.files:
            return
        x = self._xml("xl/styles.xml")
        codes = {int(f.attrib["numFmtId"]): f.attrib["formatCode"] for f in _all(x, "numFmt")}
        for block in _all(x, "cellXfs"):
            for k, f in enumerate(block):
                number = int(f.attrib.get("numFmtId", 0))
                code = codes.get(number)
                bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code or "")
                date = number in DATE_FORMATS or bool(re.search("[ymdhs]", bare, re.I) and "general" not in bare.lower())
                units = re.findall(r'"([^"]+)"', code or "")
                yield k, code, date, "%" in bare or number in (9, 10), "(" in bare, units[0].strip() if units else None, is_1904


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.name = options["path"], options.get("part", "cells")

    def partitions(self):
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = files.get_file_info(at)
        if info.is_file:
            return [_File(self.path)]
        found = files.get_file_info(fs.FileSelector(at, recursive=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [_File(scheme + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.extension in ("xlsx", "xlsm")]

    def read(self, partition):
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(partition.path if "://" in partition.path else f"file://{partition.path}")
        with files.open_input_file(at) as f:
            for row in Workbook(f.read()).part(self.name):
                yield (partition.path, *row)


class XlsxSource(DataSource):
    """The format "xlsx": one partition a file; options path and part."""

    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        return "workbook string, " + SCHEMAS[self.options.get("part", "cells")]

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def read(spark: SparkSession, path: str, part: str = "cells") -> DataFrame:
    """One part of every workbook under path, by Spark's own file listing: works for any store that Spark opens."""
    schema = SCHEMAS[part]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        names = ["workbook", *(c.split()[0] for c in schema.split(", "))]
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                rows = []
                for r in Workbook(content).part(part):
                    rows.append((p, *r))
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, "workbook string, " + schema)


def serial_date(serial, is_1904=False):
    """Column: the date of an Excel serial number."""
    base = F.when(F.lit(is_1904) if isinstance(is_1904, bool) else is_1904, F.lit("1904-01-01").cast("date")).otherwise(F.lit("1899-12-30").cast("date"))
    return F.date_add(base, F.floor(serial).cast("int"))
