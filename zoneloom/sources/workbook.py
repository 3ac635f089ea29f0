"""Sheets of workbooks (Office Open XML) as text tables."""

from __future__ import annotations

import datetime
import fnmatch
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: number formats of dates and times that need no declaration, the two day counts' origins.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
ORIGIN, ORIGIN_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)

BATCH_ROWS = 10_000

_ESCAPE = re.compile("_x([0-9A-Fa-f]{4})_")
_NOT_FORMAT = re.compile(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]')


class Sheet(InputPartition):
    """One sheet of one file: the format packs a sheet as one stream of at most 1,048,576 rows."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def elements(file, wanted: str) -> Iterator[ElementTree.Element]:
    """The elements of one name, each complete, dropped from memory when the next one is asked for."""
    events = ElementTree.iterparse(file, events=("start", "end"))
    above: list[ElementTree.Element] = []
    inner = 0
    for event, element in events:
        if event == "start":
            above.append(element)
            inner += local(element.tag) == wanted
            continue
        above.pop()
        if local(element.tag) == wanted:
            inner -= 1
            yield element
        if not inner and above:
            above[-1].remove(element)


def text_of(element: ElementTree.Element) -> str:
    """Text of a string item: its runs joined, reading aids left out, escaped characters decoded."""
    parts = []
    for child in element:
        name = local(child.tag)
        if name == "t":
            parts.append(child.text or "")
        elif name == "r":
            parts += [t.text or "" for t in child if local(t.tag) == "t"]
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def column_of(reference: str) -> int:
    """``C7`` is column 2."""
    n = 0
    for letter in reference:
        if not letter.isalpha():
            break
        n = n * 26 + ord(letter.upper()) - 64
    return n - 1


def is_date(code: str) -> bool:
    return bool(re.search("[dmyhs]", _NOT_FORMAT.sub("", code.split(";")[0]).lower()))


class Workbook:
    """One open workbook: its sheets' names, its shared strings and which cell styles show dates."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        self.names = set(self.zip.namelist())
        types = self._targets("_rels/.rels")
        book = next((t for _, kind, t in types if kind.endswith("/officeDocument")), "xl/workbook.xml")
        folder, name = posixpath.split(book)
        related = self._targets(f"{folder}/_rels/{name}.rels", folder)
        by_id = {i: target for i, _, target in related}
        self.parts = {posixpath.basename(kind): target for _, kind, target in related}
        with self.zip.open(book) as stream:
            root = ElementTree.parse(stream).getroot()
        self.sheets = {
            e.get("name"): by_id[next(v for k, v in e.attrib.items() if local(k) == "id" and k != "id")]
            for e in root.iter() if local(e.tag) == "sheet"
        }
        settings = next((e for e in root.iter() if local(e.tag) == "workbookPr"), None)
        self.origin = ORIGIN_1904 if settings is not None and settings.get("date1904") in ("1", "true") else ORIGIN
        self.dates = self._date_styles()

    def _targets(self, path: str, folder: str = "") -> list[tuple[str, str, str]]:
        if path not in self.names:
            return []
        with self.zip.open(path) as stream:
            return [
                (e.get("Id", ""), e.get("Type", ""), posixpath.normpath(posixpath.join("/", folder, e.get("Target", ""))).lstrip("/"))
                for e in ElementTree.parse(stream).getroot()
            ]

    def _date_styles(self) -> set[int]:
        path = self.parts.get("styles")
        if path not in self.names:
            return set()
        with self.zip.open(path) as stream:
            root = ElementTree.parse(stream).getroot()
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if local(e.tag) == "numFmt"}
        styles = next((e for e in root if local(e.tag) == "cellXfs"), [])
        kinds = [int(e.get("numFmtId", 0)) for e in styles]
        return {i for i, kind in enumerate(kinds) if (is_date(own[kind]) if kind in own else kind in DATE_FORMATS)}

    def strings(self) -> list[str]:
        path = self.parts.get("sharedStrings")
        if path not in self.names:
            return []
        with self.zip.open(path) as stream:
            return [text_of(e) for e in elements(stream, "si")]

    def day(self, number: float) -> str:
        """A day count as ISO text, with the time of day if it has one, the time alone below one day."""
        moment = self.origin + datetime.timedelta(seconds=round(number * 86_400))
        if 0 <= number < 1 and self.origin == ORIGIN:
            return moment.strftime("%H:%M:%S")
        return moment.strftime("%Y-%m-%d" if moment.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")

    def value(self, cell: ElementTree.Element, strings: Sequence[str]) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            found = next((e for e in cell if local(e.tag) == "is"), None)
            return None if found is None else text_of(found) or None
        raw = next((e.text for e in cell if local(e.tag) == "v"), None)
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return strings[int(raw)] or None
        if kind == "b":
            return "TRUE" if raw == "1" else "FALSE"
        if kind != "n":
            return raw
        number = float(raw)
        if int(cell.get("s", 0)) in self.dates:
            return self.day(number)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def rows(self, sheet: str | None, skip: int = 0) -> Iterator[dict[int, str]]:
        """Values by column of each row that has any, after the first ``skip`` rows of the sheet."""
        if sheet is not None and sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet!r} among {', '.join(self.sheets)}")
        strings = self.strings()
        number = 0
        with self.zip.open(self.sheets[sheet] if sheet is not None else next(iter(self.sheets.values()))) as stream:
            for row in elements(stream, "row"):
                number = int(row.get("r", number + 1))
                if number <= skip:
                    continue
                values, at = {}, -1
                for cell in row:
                    if local(cell.tag) != "c":
                        continue
                    at = column_of(cell.get("r")) if cell.get("r") else at + 1
                    text = self.value(cell, strings)
                    if text is not None:
                        values[at] = text
                if values:
                    yield values


def header_of(row: dict[int, str], path: str) -> dict[str, int]:
    """Column numbers by name; columns without a name are not part of the table."""
    names = {name: at for at, name in reversed(row.items())}
    if len(names) < len(row):
        raise ValueError(f"repeated column names in {path}")
    return dict(sorted(names.items(), key=lambda item: item[1]))


def workbooks(path: str, pattern: str) -> list[str]:
    files, root = fs.FileSystem.from_uri(path)
    found = files.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inner = [found] if found.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
    named = [i.path for i in inner if i.is_file and fnmatch.fnmatch(i.base_name, pattern) and not i.base_name.startswith("~$")]
    if not named:
        raise FileNotFoundError(f"no {pattern} below {path}")
    return sorted(named)


class SheetReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns, self.options = schema.fieldNames(), options

    def partitions(self) -> Sequence[Sheet]:
        return [Sheet(path) for path in workbooks(self.options["path"], self.options.get("pattern", "*.xlsx"))]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        with files.open_input_file(partition.path) as file:
            rows = Workbook(file).rows(self.options.get("sheet"), int(self.options.get("skip", 0)))
            header = header_of(next(rows, {}), partition.path)
            missing = [name for name in self.columns if name not in header]
            if missing:
                raise ValueError(f"no column {', '.join(missing)} in {partition.path}")
            batch: list[list[str | None]] = []
            for row in rows:
                values = [row.get(header[name]) for name in self.columns]
                if any(v is not None for v in values):
                    batch.append(values)
                if len(batch) == BATCH_ROWS:
                    yield self.arrow(batch)
                    batch = []
            if batch:
                yield self.arrow(batch)

    def arrow(self, batch: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*batch)], self.columns)


class SheetSource(DataSource):
    """``spark.read.format("zoneloom_sheets")``: a sheet's columns as text."""

    @classmethod
    def name(cls) -> str:
        return "zoneloom_sheets"

    def schema(self) -> T.StructType:
        """Names of the first file's header; the other files must have them too."""
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        first = workbooks(self.options["path"], self.options.get("pattern", "*.xlsx"))[0]
        with files.open_input_file(first) as file:
            row = next(Workbook(file).rows(self.options.get("sheet"), int(self.options.get("skip", 0))), {})
        return T.StructType([T.StructField(name, T.StringType()) for name in header_of(row, first)])

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(schema, dict(self.options))


def scan_sheets(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, sheet: str | None = None, skip: int = 0, pattern: str = "*.xlsx"
) -> DataFrame:
    """One sheet (the first unless named) of a workbook, or of all workbooks below a folder, with every column as text.

    The first row with a value after ``skip`` rows is the header; ``columns`` picks columns by name and spares the driver
    a look into the first file. Each file is one task, which holds the shared strings and passes the rows on in
    batches. Numbers come in their shortest form, dates as ISO text, booleans as TRUE and FALSE; empty cells, empty texts
    and error values are null. Rows without a value are left out, as are columns without a name.
    """
    spark.dataSource.register(SheetSource)
    source = spark.read.format("zoneloom_sheets").option("skip", str(skip)).option("pattern", pattern)
    if sheet is not None:
        source = source.option("sheet", sheet)
    if columns is not None:
        source = source.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return source.load(path)
