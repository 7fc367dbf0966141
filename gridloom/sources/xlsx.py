"""Workbook files: reading cells, formulas and names from the XML in a zip archive, and writing small ones.

The reader streams; it never makes a dense grid, since files claim extents that they don't use. ``WorkbookSource`` is the
format for ``spark.read``: one partition for each file, one row for each cell. ``read_binary`` does the same for a table of
file contents.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.functions.values import Fault, Value
from gridloom.plans import syntax as S
from gridloom.plans.rebase import moved
from gridloom.plans.workbook import Workbook

#: A cell's row: kind is n, t, b, e or null for a formula without a stored value.
CELLS = "wb string, sheet int, sheet_name string, row int, col int, kind string, num double, text string, formula string, is_array boolean"
#: Files above this many bytes aren't opened.
LARGEST = 100 << 20
ERRORS = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, RuntimeError, NotImplementedError, EOFError, OSError)

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _texts(element) -> str:
    """A string item's text, without its phonetic hints."""
    return "".join(t.text or "" for part in element if _tag(part) in ("t", "r") for t in ([part] if _tag(part) == "t" else [x for x in part if _tag(x) == "t"]))


def _resolve(target: str, base: str = "xl/") -> str:
    return target.lstrip("/") if target.startswith("/") else base + target


class File:
    def __init__(self, content: bytes):
        if content[:2] != b"PK":
            raise zipfile.BadZipFile("no zip archive")
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.parts = set(self.zip.namelist())

    def features(self) -> dict[str, bool]:
        has = lambda pattern: any(re.search(pattern, p, re.I) for p in self.parts)
        return {"vba": has(r"vbaProject\.bin$"), "external_links": has(r"^xl/externalLinks/"), "pivot_tables": has(r"^xl/pivotTables/"), "power_query": has(r"^customXml/item|^xl/queries/|DataMashup")}

    def workbook(self) -> Workbook:
        book = Workbook()
        root = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        targets = {}
        if "xl/_rels/workbook.xml.rels" in self.parts:
            targets = {r.get("Id"): _resolve(r.get("Target")) for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        shared = self._shared()
        for pr in root.iter(f"{_MAIN}workbookPr"):
            book.epoch_1904 = pr.get("date1904") in ("1", "true")
        for sheet in root.iter(f"{_MAIN}sheet"):
            own = book.add(sheet.get("name"))
            part = targets.get(sheet.get(f"{_REL}id"))
            if part in self.parts:
                for row, col, value, formula, is_array in self._cells(part, shared):
                    if value is not None:
                        own.values[row, col] = value
                    if formula is not None:
                        own.formulas[row, col] = formula
                    if is_array:
                        own.arrays.add((row, col))
        for name in root.iter(f"{_MAIN}definedName"):
            body, key = (name.text or "").strip(), (name.get("name") or "").upper()
            if "[" in body and re.search(r"\[\d+\]", body):
                book.external_names.add(key)
            elif S.parses(body) is not None:
                book.names.setdefault(key, body)
        return book

    def _shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.parts:
            return []
        return [_texts(si) for si in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")) if _tag(si) == "si"]

    def _cells(self, part: str, shared: list[str]) -> Iterator[tuple[int, int, Value, str | None, bool]]:
        groups: dict[str, tuple[S.Node | None, int, int]] = {}
        row, col = -1, -1
        with self.zip.open(part) as f:
            for event, el in ElementTree.iterparse(f, events=("start", "end")):
                tag = _tag(el)
                if event == "start":
                    if tag == "row":
                        row, col = int(el.get("r")) - 1 if el.get("r") else row + 1, -1
                    continue
                if tag == "row":
                    el.clear()
                if tag != "c":
                    continue
                cell = S.as_cell(el.get("r") or "")
                row, col = (cell[0].at, cell[1].at) if cell else (row, col + 1)
                value, formula, is_array = None, None, False
                raw = next((x for x in el if _tag(x) == "v"), None)
                inline = next((x for x in el if _tag(x) == "is"), None)
                kind = el.get("t", "n")
                if inline is not None:
                    value = _texts(inline)
                elif raw is not None and raw.text is not None:
                    value = _value(kind, raw.text, shared)
                elif raw is not None and kind == "str":
                    value = ""
                f_el = next((x for x in el if _tag(x) == "f"), None)
                if f_el is not None:
                    formula, is_array = f_el.text, f_el.get("t") == "array"
                    if f_el.get("t") == "shared":
                        key = f_el.get("si")
                        if formula:
                            groups[key] = S.parses(formula), row, col
                        elif key in groups and groups[key][0] is not None:
                            tree, r0, c0 = groups[key]
                            formula = moved(tree, row - r0, col - c0)
                if value is not None or formula is not None:
                    yield row, col, value, formula, is_array
                el.clear()


def _value(kind: str, raw: str, shared: list[str]) -> Value:
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw.strip() in ("1", "true")
    if kind == "e":
        return Fault(raw)
    if kind in ("str", "d"):
        return raw
    n = float(raw)
    return n if math.isfinite(n) else Fault("#NUM!")


def rows_of(name: str, book: Workbook) -> Iterator[tuple]:
    """A workbook's cells as rows of CELLS."""
    for i, s in enumerate(book.sheets):
        for r, c in sorted(s.values.keys() | s.formulas.keys()):
            v = s.values.get((r, c))
            kind = None if v is None else "e" if isinstance(v, Fault) else "b" if isinstance(v, bool) else "t" if isinstance(v, str) else "n"
            num = float(v) if kind in ("n", "b") else None
            text = v.code if kind == "e" else v if kind == "t" else None
            yield name, i, s.name, r, c, kind, num, text, s.formulas.get((r, c)), (r, c) in s.arrays


def value_of(kind: str | None, num: float | None, text: str | None) -> Value:
    return None if kind is None else num if kind == "n" else bool(num) if kind == "b" else Fault(text) if kind == "e" else text


def books_of(rows) -> dict[str, Workbook]:
    """Workbooks again from rows of CELLS, by name."""
    out: dict[str, Workbook] = {}
    for wb, sheet, sheet_name, row, col, kind, num, text, formula, is_array in rows:
        book = out.setdefault(wb, Workbook())
        while len(book.sheets) <= sheet:
            book.add("")
        own = book.sheets[sheet]
        own.name = sheet_name
        if kind is not None:
            own.values[row, col] = value_of(kind, num, text)
        if formula is not None:
            own.formulas[row, col] = formula
        if is_array:
            own.arrays.add((row, col))
    return out


class WorkbookSource(DataSource):
    """spark.dataSource.register(WorkbookSource); spark.read.format("workbook").load(path). A folder is searched for files
    that begin like zip archives. Files that don't open give no rows; ``surveyed`` says why."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path", ""))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        top = Path(self.path.removeprefix("file://"))
        found = [top] if top.is_file() else sorted(p for p in top.rglob("*") if p.is_file())
        return [InputPartition(str(p)) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            content = f.read(2)
            content += f.read() if content == b"PK" else b""
        try:
            yield from rows_of(partition.value, File(content).workbook())
        except ERRORS:
            return


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """wb, content of all files below a path that begin like zip archives, read by Spark, so any store will do."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.where((F.col("length") <= LARGEST) & (F.substring("content", 1, 2) == F.lit(b"PK"))).select(F.col("path").alias("wb"), "content")


def read_binary(files: DataFrame) -> DataFrame:
    """Rows of CELLS for a table of wb, content."""

    def step(frames):
        import pandas as pd

        names = [f.split()[0] for f in CELLS.split(", ")]
        for frame in frames:
            for wb, content in zip(frame["wb"], frame["content"], strict=True):
                try:
                    yield pd.DataFrame(list(rows_of(wb, File(bytes(content)).workbook())), columns=names)
                except ERRORS:
                    continue

    return files.select("wb", "content").mapInPandas(step, CELLS)


SURVEY = "path string, sha256 string, bytes long, status string, error string, sheets int, formula_cells int, vba boolean, external_links boolean, pivot_tables boolean, power_query boolean, tables int, defined_names int, epoch_1904 boolean"


def survey_of(path: str, content: bytes, size: int) -> tuple:
    """One file's row: status ok, not_zip, too_large, open_error or read_error."""
    sha = hashlib.sha256(content).hexdigest()
    empty = (0, 0, False, False, False, False, 0, 0, False)
    if size > LARGEST:
        return path, sha, size, "too_large", None, *empty
    if content[:2] != b"PK":
        return path, sha, size, "not_zip", None, *empty
    try:
        own = File(content)
    except ERRORS as e:
        return path, sha, size, "open_error", str(e), *empty
    try:
        book, has = own.workbook(), own.features()
    except ERRORS as e:
        return path, sha, size, "read_error", str(e), *empty
    tables = sum(bool(re.search(r"^xl/tables/[^/]+\.xml$", p)) for p in own.parts)
    return path, sha, size, "ok", None, len(book.sheets), sum(len(s.formulas) for s in book.sheets), has["vba"], has["external_links"], has["pivot_tables"], has["power_query"], tables, len(book.names) + len(book.external_names), book.epoch_1904


def surveyed(files: DataFrame) -> DataFrame:
    """A row of SURVEY for each file of a table of path, content, length."""

    def step(frames):
        import pandas as pd

        names = [f.split()[0] for f in SURVEY.split(", ")]
        for frame in frames:
            yield pd.DataFrame([survey_of(p, bytes(c), int(n)) for p, c, n in zip(frame["path"], frame["content"], frame["length"], strict=True)], columns=names)

    return files.select("path", "content", "length").mapInPandas(step, SURVEY)


def subset(survey: DataFrame, least_formulas: int = 10, first: int = 500) -> DataFrame:
    """The readable workbooks with formulas, one of each content, in the order of their digests."""
    ok = survey.where((F.col("status") == "ok") & (F.col("formula_cells") >= least_formulas))
    one = ok.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in ok.columns if c != "sha256"]), "path").alias("r"))
    return one.select("sha256", "r.*").orderBy("sha256").limit(first)


def unloadable(survey: DataFrame) -> DataFrame:
    """The files of a corpus that don't load or hold no formula."""
    return survey.where((F.col("status") != "ok") | (F.col("formula_cells") < 1)).select("path", "status", "error")


def verified(manifest: DataFrame, survey: DataFrame) -> DataFrame:
    """The manifest's entries (file, sha256) that are missing or have changed."""
    found = survey.select(F.col("path").alias("file"), F.col("sha256").alias("found"))
    return manifest.join(found, "file", "left").where(F.col("found").isNull() | (F.col("found") != F.col("sha256")))


def write(book: Workbook) -> bytes:
    """A small workbook file: values, formulas with their stored values, and names."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, body: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)

        n = len(book.sheets)
        main, rel = _MAIN.strip("{}"), _REL.strip("{}")
        types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        put("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{types}.worksheet+xml"/>' for i in range(1, n + 1)) + "</Types>")  # fmt: skip
        put("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<definedName name="{escape(k)}">{escape(v)}</definedName>' for k, v in book.names.items())
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr{" date1904=\"1\"" if book.epoch_1904 else ""}/><sheets>' + "".join(f'<sheet name="{escape(s.name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(book.sheets, 1)) + "</sheets>" + (f"<definedNames>{names}</definedNames>" if names else "") + "</workbook>")
        put("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
        for i, s in enumerate(book.sheets, 1):
            lines: dict[int, list[str]] = {}
            for r, c in sorted(s.values.keys() | s.formulas.keys()):
                lines.setdefault(r, []).append(_xml(s, r, c))
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r + 1}">' + "".join(cells) + "</row>" for r, cells in lines.items()) + "</sheetData></worksheet>")
    return out.getvalue()


def _xml(s, r: int, c: int) -> str:
    v, formula = s.values.get((r, c)), s.formulas.get((r, c))
    kind = "" if v is None else ' t="e"' if isinstance(v, Fault) else ' t="b"' if isinstance(v, bool) else ' t="str"' if isinstance(v, str) else ""
    shown = "" if v is None else f"<v>{escape(v.code if isinstance(v, Fault) else str(int(v)) if isinstance(v, bool) else v if isinstance(v, str) else repr(v))}</v>"
    marked = ' t="array" ref="' + S.cell_name(r, c) + '"' if (r, c) in s.arrays else ""
    f = "" if formula is None else f"<f{marked}>{escape(formula)}</f>"
    return f'<c r="{S.cell_name(r, c)}"{kind}>{f}{shown}</c>'
