"""Excel workbooks as a Spark source: sheets are streamed by tasks, and Spark finds out the columns and their types."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .session import ship

CELLS = "path string, sheet string, row long, cells map<string,string>"
#: Number formats that are dates, and how a format is told to be one.
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}
_DATE_CODE = re.compile(r"[ymdhs]", re.IGNORECASE)
_LITERAL = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.|_.')
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: A cell's kind stands before its text: i whole number, f other number, b truth, d moment, s text.
TYPES = [({"i"}, "bigint"), ({"i", "f"}, "double"), ({"b"}, "boolean"), ({"d"}, "timestamp")]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _open(path: str):
    store, at = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return store.open_input_file(at)


class Workbook:
    """An open workbook: names of its sheets, and their rows one after another."""

    def __init__(self, source, name: str = ""):
        try:
            self.zip = zipfile.ZipFile(source)
            book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
            links = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
            raise ValueError(f"{name} is no workbook: {e}") from e
        targets = {r.get("Id"): r.get("Target") for r in links}
        of = lambda kind: (x for x in book.iter() if _local(x.tag) == kind)
        self.sheets = {s.get("name"): self._part(targets[s.get(_RELATION)]) for s in of("sheet") if s.get(_RELATION) in targets}
        since_1904 = any(p.get("date1904") in ("1", "true") for p in of("workbookPr"))
        self.day_0, self.name = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30), name
        self.dates, self.strings = self._date_styles(), self._shared()

    @staticmethod
    def _part(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        codes = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter() if _local(x.tag) == "numFmt"}
        own = {n for n, code in codes.items() if _DATE_CODE.search(_LITERAL.sub("", code))} | DATE_FORMATS
        cells = next((x for x in root.iter() if _local(x.tag) == "cellXfs"), ())
        return {i for i, x in enumerate(cells) if int(x.get("numFmtId", 0)) in own}

    def _shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        out = []
        with self.zip.open("xl/sharedStrings.xml") as xml:
            for _, x in ElementTree.iterparse(xml):
                if _local(x.tag) == "si":
                    out.append(_text(x))
                    x.clear()
        return out

    def sheet(self, wanted: str) -> str:
        """The name of a sheet that is named, or numbered from 0."""
        names = list(self.sheets)
        if wanted in self.sheets:
            return wanted
        if re.fullmatch(r"\d+", wanted) and int(wanted) < len(names):
            return names[int(wanted)]
        raise ValueError(f"{self.name} has no sheet {wanted}; there are: {', '.join(names)}")

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, str]]]:
        """Number (from 1) and filled cells by column (from 0) of each row that has any."""
        with self.zip.open(self.sheets[sheet]) as xml:
            number = 0
            for _, x in ElementTree.iterparse(xml):
                if _local(x.tag) != "row":
                    continue
                number = int(x.get("r") or number + 1)
                cells, column = {}, -1
                for c in x:
                    place = re.match("[A-Z]+", c.get("r") or "")
                    column = _column(place[0]) if place else column + 1
                    if (value := self._value(c)) is not None:
                        cells[column] = value
                x.clear()
                if cells:
                    yield number, cells

    def _value(self, cell) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            text = _text(cell)
            return f"s{text}" if text else None
        raw = next((v.text for v in cell if _local(v.tag) == "v"), None)
        if raw is None or kind == "e":
            return None
        if kind == "s":
            text = self.strings[int(raw)]
            return f"s{text}" if text else None
        if kind == "b":
            return "btrue" if raw == "1" else "bfalse"
        if kind in ("str", "d"):
            return f"s{raw}" if kind == "str" else f"d{raw}"
        number = float(raw)
        if int(cell.get("s") or -1) in self.dates:
            return "d" + (self.day_0 + timedelta(seconds=round(number * 86400))).isoformat(" ")
        return f"i{int(number)}" if number.is_integer() and abs(number) < 2**53 else f"f{number!r}"


def _text(x) -> str:
    """Texts of an element, but for readings in small print."""
    return "".join(t.text or "" for r in x if _local(r.tag) != "rPh" for t in r.iter() if _local(t.tag) == "t")


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def header_names(cells: dict[int, str]) -> list[str]:
    """Names of the columns: blank ones by their place, repeated ones with a number."""
    out: list[str] = []
    for i in range(max(cells, default=-1) + 1):
        name = cells.get(i, "")[1:].strip() or f"Unnamed: {i}"
        n, unique = 0, name
        while unique in out:
            n += 1
            unique = f"{name}.{n}"
        out.append(unique)
    return out


class _Sheet(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.wanted = options["paths"].split("\n"), options.get("sheet", "0")

    def partitions(self) -> list[_Sheet]:
        return [_Sheet(p) for p in self.paths]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        with _open(partition.path) as source:
            book = Workbook(source, partition.path)
            sheet, names = book.sheet(self.wanted), None
            for number, cells in book.rows(sheet):
                if names is None:
                    names = header_names(cells)
                    # a row of no values tells the columns of a sheet without any other
                    yield partition.path, sheet, 0, dict.fromkeys(names)
                else:
                    more = {f"Unnamed: {i}": v for i, v in cells.items() if i >= len(names)}
                    yield partition.path, sheet, number, {n: cells.get(i) for i, n in enumerate(names)} | more


class XlsxCells(DataSource):
    """Rows of a sheet of each workbook: path, sheet, row, cells (name to kind and text). Options: paths, a line each; sheet."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_xlsx(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """The rows of a sheet (by name, or number from 0) of a workbook, or of each workbook of a folder, as a table.

    The first row that isn't blank names the columns. A column of whole numbers is a bigint, one with other numbers a double, one
    of moments a timestamp, one of truth values a boolean, any other a text; blank cells are null, blank rows are left out.
    A file that is no workbook, or has no such sheet, is an error that names it. Each file is one task's stream.
    """
    ship(spark)
    spark.dataSource.register(XlsxCells)
    # names of files come from Spark's listing, so any store that Spark lists will do
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("path").rlike(r"(?i)\.xls[xm]$"))
    paths = sorted(r.path for r in listed.select("path").collect())
    if not paths:
        raise ValueError(f"no workbook in {path}")
    rows = spark.read.format("xlsx_cells").option("paths", "\n".join(paths)).option("sheet", str(sheet)).load()
    entries = rows.select(F.posexplode(F.map_entries("cells")).alias("at", "cell"))
    kinds = F.collect_set(F.substring("cell.value", 1, 1)).alias("kinds")
    columns = entries.groupBy("cell.key").agg(F.min("at").alias("at"), kinds).orderBy("at", "key").collect()
    typed = []
    for c in columns:
        kind = next((t for accepted, t in TYPES if c.kinds and set(c.kinds) <= accepted), "string")
        typed.append(F.substring(F.try_element_at("cells", F.lit(c.key)), 2, 1 << 30).cast(kind).alias(c.key))
    return rows.filter("row > 0").select(*typed)
