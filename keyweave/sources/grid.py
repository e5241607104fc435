"""CSV, TSV and XLSX files as raw grids, and grids as tables.

A spreadsheet file is one task's work; many files are many tasks.  Files are read through Spark, so
any file system that Spark knows will do, and come out as (__file, __row_no, cells).  Headers may
repeat, so table columns are named by position (``a_col_0``) and keep the header as metadata.
Large, well-formed UTF-8 files are read by ``read_large_csv``, which Spark splits.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.cluster import cut, ship
from keyweave.functions.normalize import excel_letter, fingerprint

#: Encodings in the order they are tried; the last takes anything.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin-1")
DELIMITERS = ",;\t|"
EXTENSIONS = {".csv": "csv", ".tsv": "csv", ".xlsx": "xlsx", ".xlsm": "xlsx"}
GRID = "__file string, __row_no long, cells array<string>"


class SourceError(ValueError):
    """``code`` names what is wrong with a file."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code

    def __reduce__(self):
        return SourceError, (self.code, str(self).partition(": ")[2])


@dataclass(frozen=True)
class Limits:
    """Caps on a file; None means none."""

    max_bytes: int | None = None
    max_rows: int | None = None
    max_columns: int | None = None
    max_cells: int | None = None
    max_entries: int | None = 2_000
    max_uncompressed: int | None = None
    max_ratio: float | None = None

    def check(self, rows: int, columns: int) -> None:
        for what, now, most in (("rows", rows, self.max_rows), ("columns", columns, self.max_columns), ("cells", rows * columns, self.max_cells)):
            if most is not None and now > most:
                raise SourceError("RESOURCE_LIMIT", f"more than {most} {what}")


#: The caps of a reader that has little memory.
STRICT_CSV = Limits(64 << 20, 1_000_000, 512, 5_000_000)
STRICT_XLSX = Limits(128 << 20, 1_000_000, 512, 5_000_000, 2_000, 256 << 20, 100)


def kind_of(name: str) -> str:
    suffix = "." + name.rpartition(".")[2].lower()
    if suffix not in EXTENSIONS:
        raise SourceError("UNSUPPORTED_FORMAT", f"{name} isn't one of {', '.join(EXTENSIONS)}")
    return EXTENSIONS[suffix]


def validate_upload(name: str, size: int, most: int = 200 << 20) -> None:
    kind_of(name)
    if size > most:
        raise SourceError("RESOURCE_LIMIT", f"{name} has more than {most} bytes")


def detect_encoding(payload: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            payload.decode(encoding)
        except UnicodeDecodeError:
            continue
        return encoding
    return "utf-8"


def detect_delimiter(payload: bytes, encoding: str) -> str:
    try:
        return csv.Sniffer().sniff(payload[:10_000].decode(encoding, "replace"), delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def csv_rows(payload: bytes, encoding: str | None = None, delimiter: str | None = None) -> list[list[str]]:
    """Rows of a file; quoted line breaks stay, an empty cell is the empty text."""
    encoding = encoding or detect_encoding(payload)
    delimiter = delimiter or detect_delimiter(payload, encoding)
    try:
        return list(csv.reader(io.StringIO(payload.decode(encoding), newline=""), delimiter=delimiter, strict=True))
    except (UnicodeDecodeError, LookupError, csv.Error) as error:
        raise SourceError("MALFORMED_CSV", str(error)) from error



def strict_csv_rows(payload: bytes, delimiter: str = ",", limits: Limits = STRICT_CSV) -> list[list[str]]:
    """The stricter dialect: UTF-8 alone, quotes only around whole fields, blanks allowed after a closing quote."""
    if limits.max_bytes is not None and len(payload) > limits.max_bytes:
        raise SourceError("RESOURCE_LIMIT", f"more than {limits.max_bytes} bytes")
    if delimiter not in tuple(DELIMITERS):
        raise SourceError("INVALID_DELIMITER", "comma, semicolon, tab or pipe")
    try:
        text = payload.decode("utf-8-sig")
    except UnicodeDecodeError as error:
        raise SourceError("INVALID_UTF8", str(error)) from error
    if not text.strip():
        raise SourceError("EMPTY_INPUT", "the file is empty")
    plain = re.compile(f"[^{re.escape(delimiter)}\r\n]*")
    rows, row, at = [], [], 0
    while at < len(text):
        if text[at] == '"':
            quoted = re.compile(r'"((?:[^"]|"")*)"').match(text, at)
            if not quoted:
                raise SourceError("MALFORMED_CSV", "the file ends in a quoted field")
            row.append(quoted[1].replace('""', '"'))
            at = quoted.end()
            while at < len(text) and text[at] in " \t" and text[at] != delimiter:
                at += 1
            if at < len(text) and text[at] not in delimiter + "\r\n":
                raise SourceError("MALFORMED_CSV", f"{text[at]!r} after a closing quote at {at}")
        else:
            found = plain.match(text, at)
            row.append(found[0])
            at = found.end()
        if at < len(text) and text[at] == delimiter:
            at += 1
            if at == len(text):
                row.append("")
        else:
            rows.append(row)
            row = []
            at += 2 if text[at : at + 2] == "\r\n" else 1
    if row:
        rows.append(row)
    limits.check(max(len(rows) - 1, 0), max(map(len, rows), default=0))
    return rows


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node.iter() if _local(x.tag) == name]


class Workbook:
    """Sheets and cells of an XLSX file, by the standard library alone; namespaces are not looked at."""

    def __init__(self, payload: bytes, limits: Limits = Limits(), reject_formulas: bool = False):
        self.reject_formulas = reject_formulas
        self.zip = self._preflight(payload, limits)
        self.limits = limits
        self.sheets = self._sheets()
        self.strings = self._strings()

    @staticmethod
    def _preflight(payload: bytes, limits: Limits) -> zipfile.ZipFile:
        if limits.max_bytes is not None and len(payload) > limits.max_bytes:
            raise SourceError("RESOURCE_LIMIT", f"more than {limits.max_bytes} bytes")
        try:
            archive = zipfile.ZipFile(io.BytesIO(payload))
        except (zipfile.BadZipFile, struct.error) as error:
            raise SourceError("INVALID_ZIP", str(error)) from error
        entries = archive.infolist()
        if limits.max_entries is not None and len(entries) > limits.max_entries:
            raise SourceError("RESOURCE_LIMIT", f"more than {limits.max_entries} entries")
        total = 0
        for e in entries:
            total += e.file_size
            if e.flag_bits & 1:
                raise SourceError("ENCRYPTED", e.filename)
            if e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise SourceError("UNSUPPORTED_COMPRESSION", e.filename)
            if e.filename.startswith("/") or ".." in e.filename.replace("\\", "/").split("/"):
                raise SourceError("UNSAFE_PATH", e.filename)
            if limits.max_ratio is not None and e.file_size > limits.max_ratio * max(e.compress_size, 1):
                raise SourceError("RESOURCE_LIMIT", f"{e.filename} is packed too tightly")
            if e.filename.lower().endswith("vbaproject.bin") and limits.max_ratio is not None:
                raise SourceError("MACROS", e.filename)
        if limits.max_uncompressed is not None and total > limits.max_uncompressed:
            raise SourceError("RESOURCE_LIMIT", f"more than {limits.max_uncompressed} bytes unpacked")
        return archive

    def _xml(self, name: str) -> ET.Element | None:
        try:
            raw = self.zip.read(name)
        except KeyError:
            return None
        if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
            raise SourceError("MALFORMED_XLSX", f"{name} declares entities")
        try:
            return ET.fromstring(raw)
        except ET.ParseError as error:
            raise SourceError("MALFORMED_XLSX", f"{name}: {error}") from error

    def _sheets(self) -> dict[str, str]:
        book, links = self._xml("xl/workbook.xml"), self._xml("xl/_rels/workbook.xml.rels")
        if book is None or links is None:
            raise SourceError("MALFORMED_XLSX", "no workbook")
        target = {}
        for link in _children(links, "Relationship"):
            path = link.get("Target", "")
            target[link.get("Id")] = posixpath.normpath(path.lstrip("/") if path.startswith("/") else posixpath.join("xl", path))
        out = {}
        for sheet in _children(book, "sheet"):
            link = next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None)
            if link in target:
                out[sheet.get("name", "")] = target[link]
        if not out:
            raise SourceError("NO_SHEETS", "the workbook has no worksheets")
        return out

    def _strings(self) -> list[str]:
        root = self._xml("xl/sharedStrings.xml")
        if root is None:
            return []
        return ["".join(t.text or "" for t in _children(item, "t")) for item in root if _local(item.tag) == "si"]

    def rows(self, sheet: str | None = None) -> list[list[str | None]]:
        """Cells of a sheet as text: a formula's stored value, booleans as True and False."""
        name = sheet if sheet is not None else next(iter(self.sheets))
        if name not in self.sheets:
            raise SourceError("NO_SHEET", name)
        root = self._xml(self.sheets[name])
        if root is None:
            raise SourceError("MALFORMED_XLSX", f"no {self.sheets[name]}")
        out: list[list[str | None]] = []
        for row in _children(root, "row"):
            number = int(row.get("r") or len(out) + 1)
            while len(out) < number - 1:
                out.append([])
            cells: list[str | None] = []
            for cell in (x for x in row if _local(x.tag) == "c"):
                if m := re.match(r"([A-Z]+)", cell.get("r", "")):
                    column = 0
                    for letter in m[1]:
                        column = column * 26 + ord(letter) - 64
                    while len(cells) < column - 1:
                        cells.append(None)
                cells.append(self._value(cell))
            out.append(cells)
        self.limits.check(max(len(out) - 1, 0), max(map(len, out), default=0))
        return out

    def _value(self, cell: ET.Element) -> str | None:
        parts = {_local(x.tag): x for x in cell}
        if self.reject_formulas and "f" in parts:
            raise SourceError("FORMULA", cell.get("r", ""))
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in _children(cell, "t"))
        raw = parts["v"].text if "v" in parts else None
        if raw is None:
            return None
        if kind == "s":
            try:
                return self.strings[int(raw)]
            except (ValueError, IndexError) as error:
                raise SourceError("MALFORMED_XLSX", f"shared string {raw}") from error
        if kind == "b":
            return "True" if raw == "1" else "False"
        if kind == "n" and re.fullmatch(r"-?\d+\.0+", raw):
            return raw.split(".")[0]
        return raw


def file_rows(name: str, payload: bytes, sheet: str | None = None, encoding: str | None = None, delimiter: str | None = None, strict: bool = False, limits: Limits | None = None, reject_formulas: bool = False) -> list[list[str | None]]:
    if kind_of(name) == "xlsx":
        return Workbook(payload, limits or (STRICT_XLSX if strict else Limits()), reject_formulas=reject_formulas).rows(sheet)
    tab = "\t" if name.lower().endswith(".tsv") else None
    if strict:
        return strict_csv_rows(payload, delimiter or tab or ",", limits or STRICT_CSV)
    if limits and limits.max_bytes is not None and len(payload) > limits.max_bytes:
        raise SourceError("RESOURCE_LIMIT", f"more than {limits.max_bytes} bytes")
    rows = csv_rows(payload, encoding, delimiter or tab)
    if limits:
        limits.check(len(rows), max(map(len, rows), default=0))
    return rows


def read_grid(spark: SparkSession, path: str, sheet: str | None = None, encoding: str | None = None, delimiter: str | None = None, strict: bool = False, limits: Limits | None = None, reject_formulas: bool = False) -> DataFrame:
    """(__file, __row_no, cells) of one file or many; row numbers count from 1 in each file.

    ``strict`` reads CSV by the stricter rules, with its limits unless ``limits`` says otherwise;
    ``reject_formulas`` makes a formula in a workbook an error.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = pa.schema([("__file", pa.string()), ("__row_no", pa.int64()), ("cells", pa.list_(pa.string()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = file_rows(name, payload, sheet, encoding, delimiter, strict, limits, reject_formulas)
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(range(at + 1, at + 1 + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))], schema=schema)

    return files.mapInArrow(parse, GRID)


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    row = spark.read.format("binaryFile").load(path).select("path", "content").first()
    return ["CSV"] if kind_of(row.path) == "csv" else list(Workbook(bytes(row.content)).sheets)


@dataclass(frozen=True)
class ColumnRef:
    """A column by position; names may repeat."""

    index: int
    letter: str
    name: str
    column_id: str
    occurrence: int

    @property
    def display_name(self) -> str:
        return f"{self.name.strip() or '(no name)'} [{self.letter}]"

    def expectation(self, side: str, sheet: str | None = None) -> dict:
        """What a template remembers of the column."""
        name = fingerprint(self.name)
        return {"side": side, "index": self.index, "id": self.column_id, "raw": self.name, "display": self.display_name, "normalized_name": name, "sheet": sheet, "fingerprint": f"{name}#{self.occurrence}", "occurrence": self.occurrence}


@dataclass
class Table:
    df: DataFrame
    columns: list[ColumnRef] = field(default_factory=list)

    def column(self, name: str, occurrence: int = 0) -> str:
        """The id of a header's n-th column."""
        return next(c.column_id for c in self.columns if c.name == name and c.occurrence == occurrence)


def preview(grid: DataFrame, rows: int = 20) -> DataFrame:
    return grid.where(F.col("__row_no") <= rows).orderBy("__file", "__row_no")


def unique_headers(names: list[str], blank: str = "column_{}") -> list[str]:
    """Blank headers numbered, repeated ones with _2, _3."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names, start=1):
        base = name.strip() or blank.format(i)
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def promote(grid: DataFrame, header_row: int = 1, data_start_row: int = 2, side: str = "a", drop_empty_rows: bool = True, drop_empty_columns: bool = True, unique: bool = False) -> Table:
    """The grid of one file as a table: a header row, the rows from ``data_start_row`` on, without empty rows and columns.

    An empty CSV cell is a text and not empty in this sense; a missing cell is.
    """
    if header_row < 1 or data_start_row < header_row + 1:
        raise SourceError("INVALID_HEADER_OFFSET", "the header row must come before the data")
    head = grid.where(F.col("__row_no") == header_row).select("cells").first()
    if head is None:
        raise SourceError("INVALID_HEADER_OFFSET", "the header row isn't in the file")
    rows = grid.where(F.col("__row_no") >= data_start_row)
    width = max(len(head.cells), rows.agg(F.max(F.size("cells"))).first()[0] or 0)
    headers = [x or "" for x in head.cells] + [""] * (width - len(head.cells))
    headers = unique_headers(headers) if unique else headers
    cells = [F.get(F.col("cells"), i) for i in range(width)]
    if drop_empty_rows and cells:
        rows = rows.where(F.exists("cells", lambda x: x.isNotNull()))
    kept = list(range(width))
    if drop_empty_columns and kept:
        full = rows.agg(*[F.coalesce(F.bool_or(c.isNotNull()), F.lit(False)).alias(f"c{i}") for i, c in enumerate(cells)]).first()
        kept = [i for i in kept if full[f"c{i}"]]
    refs, seen = [], {}
    for i in kept:
        seen[headers[i]] = seen.get(headers[i], -1) + 1
        refs.append(ColumnRef(i, excel_letter(i), headers[i], f"{side.lower()}_col_{i}", seen[headers[i]]))
    named = [cells[r.index].alias(r.column_id, metadata={"name": r.name, "letter": r.letter, "index": r.index}) for r in refs]
    return Table(rows.select("__row_no", *named), refs)


def load(spark: SparkSession, path: str, header_row: int = 1, data_start_row: int = 2, side: str = "a", sheet: str | None = None, **options) -> Table:
    """A file as a table; options of ``read_grid`` and ``promote``.

    The grid is written to the shared folder once, so the file is parsed once however often the table is read.
    """
    reading = {k: options.pop(k) for k in ("encoding", "delimiter", "strict", "limits", "reject_formulas") if k in options}
    return promote(cut(read_grid(spark, path, sheet, **reading)), header_row, data_start_row, side, **options)


def read_large_csv(spark: SparkSession, path: str, delimiter: str = ",", side: str = "a", multiline: bool = False) -> Table:
    """Well-formed UTF-8 files with one header line, read by Spark: of any size, and split unless ``multiline``.

    All files have the columns of the first one's header; blank lines aren't rows, and cells that a row
    lacks read as empty ones, which are texts.  ``__row_no`` counts
    from 2 in each file, as lines do: the rows of each split are numbered where they are, and only the
    number of rows of each split is gathered and summed.
    """
    first = spark.read.text(path).first()
    if first is None:
        raise SourceError("EMPTY_INPUT", "the file is empty")
    headers = next(csv.reader([first.value.removeprefix("\ufeff")], delimiter=delimiter))
    seen: dict[str, int] = {}
    refs = []
    for i, name in enumerate(headers):
        seen[name] = seen.get(name, -1) + 1
        refs.append(ColumnRef(i, excel_letter(i), name, f"{side.lower()}_col_{i}", seen[name]))
    schema = T.StructType([T.StructField(r.column_id, T.StringType(), metadata={"name": r.name, "letter": r.letter, "index": r.index}) for r in refs])
    rows = spark.read.schema(schema).csv(path, sep=delimiter, header=True, quote='"', escape='"', multiLine=multiline, enforceSchema=True)
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    splits = placed.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__file", "__block", "__first", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    numbered = placed.join(offsets, ["__file", "__block"])
    return Table(numbered.select("__file", (F.col("__at") - F.col("__first") + F.col("__before") + 2).alias("__row_no"), *[F.coalesce(f.name, F.lit("")).alias(f.name, metadata=f.metadata) for f in schema]), refs)
