"""The .xlsx source: a row for each cell, and a row of facts for each workbook.

Files come through Spark's binaryFile reader, so any store that Spark reads will do; each file is unpacked in the task that
holds it. A cell's literal, or the value its formula had when the file was saved, is spread over kind, number, text,
bool and err.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from ..formula.syntax import parse, translate, unparse
from ..formula.values import KINDS, Refusal, column_number

CELLS = (
    "workbook_id string, sheet_index int, sheet string, row int, col int, kind string, number double, text string, bool boolean, err string, "
    "formula string, has_cache boolean, from_shared boolean, array_formula boolean"
)
FACTS = "workbook_id string, sheets array<string>, names array<struct<name:string,formula:string,sheet:int>>, date1904 boolean, full_calc_on_load boolean, iterative boolean, has_calc_chain boolean, writer string"
_REFERENCE = re.compile(r"([A-Za-z]{1,3})(\d+)")
#: What XML does not allow, as character references: left as written rather than failing the file.
_BAD_ENTITY = re.compile(rb"&#(?:x0*(?:[0-8bcefBCEF]|1[0-9a-fA-F]|[dD][89a-fA-F][0-9a-fA-F]{2}|[fF]{3}[ef])|0*(?:[0-8]|1[124-9]|2\d|3[01]));")


def _xml(data: bytes):
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return ElementTree.fromstring(_BAD_ENTITY.sub(lambda m: b"&amp;" + m[0][1:], data))


def _tag(node) -> str:
    return node.tag.rpartition("}")[2]


def _all(node, name: str):
    return (x for x in node.iter() if _tag(x) == name)


def _texts(node) -> str:
    return "".join(t.text or "" for t in _all(node, "t"))


def scalar(kind: str | None, text: str | None, shared: list[str]):
    """The value of a cell's <v> by its type; dates and numbers that do not parse stay text."""
    if text is None:
        return None
    if kind == "s":
        k = int(text) if text.strip().isdigit() else -1
        return shared[k] if 0 <= k < len(shared) else None
    if kind in ("str", "inlineStr", "d"):
        return text
    if kind == "b":
        return text.strip() in ("1", "true")
    if kind == "e":
        return {"err": text if text in KINDS else "#VALUE!"}
    if not text.strip():
        return None
    try:
        return float(text)
    except ValueError:
        return text


def spread(v) -> tuple:
    """(kind, number, text, bool, err) of a value."""
    if v is None:
        return "blank", None, None, None, None
    if isinstance(v, dict):
        return "err", None, None, None, v["err"]
    if isinstance(v, bool):
        return "bool", None, None, v, None
    if isinstance(v, float):
        return "num", v, None, None, None
    return "text", None, v, None, None


class Package:
    """An unzipped workbook; only a missing xl/workbook.xml is an error."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.parts = {n.lstrip("/"): n for n in self.zip.namelist()}
        if "xl/workbook.xml" not in self.parts:
            raise ValueError("xl/workbook.xml is missing")
        book = _xml(self.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in _all(_xml(self.read("xl/_rels/workbook.xml.rels")), "Relationship")} if "xl/_rels/workbook.xml.rels" in self.parts else {}
        relation = lambda s: next((v for k, v in s.attrib.items() if k.rpartition("}")[2] == "id"), None)
        self.sheets = [(s.get("name") or "", targets.get(relation(s))) for s in _all(book, "sheet")]
        self.names = [(n.get("name"), n.text or "", int(n.get("localSheetId")) if n.get("localSheetId") else None) for n in _all(book, "definedName") if not (n.get("name") or "").startswith("_xlnm.")]
        flag = lambda tag, name: any(x.get(name) in ("1", "true") for x in _all(book, tag))
        self.date1904, self.full_calc, self.iterative = flag("workbookPr", "date1904"), flag("calcPr", "fullCalcOnLoad"), flag("calcPr", "iterate")
        self.calc_chain = "xl/calcChain.xml" in self.parts
        self.writer = next((x.text for x in _all(_xml(self.read("docProps/app.xml")), "Application")), None) if "docProps/app.xml" in self.parts else None
        self.shared = [_texts(si) for si in _all(_xml(self.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in self.parts else []

    def read(self, name: str) -> bytes:
        return self.zip.read(self.parts[name])

    def cells(self, k: int):
        """(row, col, value, formula, has_cache, from_shared, array_formula) of sheet k; a missing part is an empty sheet."""
        target = self.sheets[k][1]
        path = None if target is None else target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if path not in self.parts:
            return
        masters: dict[str, tuple] = {}
        for c in _all(_xml(self.read(path)), "c"):
            m = _REFERENCE.fullmatch(c.get("r") or "")
            if not m:
                continue
            row, col, kind = int(m[2]), column_number(m[1]), c.get("t")
            v = next((x for x in c if _tag(x) == "v"), None)
            f = next((x for x in c if _tag(x) == "f"), None)
            inline = next((x for x in c if _tag(x) == "is"), None)
            text = _texts(inline) if inline is not None and kind == "inlineStr" else None if v is None else v.text or ""
            formula, from_shared, array = None, False, False
            if f is not None:
                array = f.get("t") == "array"
                formula = f.text or None
                if f.get("t") == "shared" and f.get("si") is not None:
                    if formula:
                        masters[f.get("si")] = row, col, formula
                    elif f.get("si") in masters:
                        formula, from_shared = self._sibling(*masters[f.get("si")], row, col), True
            has_cache = formula is not None and (bool(text) or kind == "str" and v is not None)
            value = scalar(kind, text, self.shared) if formula is None or has_cache else None
            if formula is not None or value is not None:
                yield row, col, value, formula, has_cache, from_shared, array

    @staticmethod
    def _sibling(row0: int, col0: int, formula: str, row: int, col: int) -> str:
        try:
            return unparse(translate(parse(formula), row - row0, col - col0))
        except Refusal:
            return formula


def read_cells(workbook_id: str, data: bytes):
    package = Package(data)
    for k, (name, _) in enumerate(package.sheets):
        for row, col, value, formula, has_cache, shared, array in package.cells(k):
            yield (workbook_id, k, name, row, col, *spread(value), formula, has_cache, shared, array)


def read_facts(workbook_id: str, data: bytes) -> tuple:
    p = Package(data)
    names = [{"name": n, "formula": f, "sheet": s} for n, f, s in p.names]
    return workbook_id, [n for n, _ in p.sheets], names, p.date1904, p.full_calc, p.iterative, p.calc_chain, p.writer


def read_context(workbook_id: str, data: bytes):
    """Rows of kind ``name`` and ``1904``, in the shape of cells: what holds for the whole workbook."""
    package, blank = Package(data), spread(None)
    for name, formula, sheet in package.names:
        yield (workbook_id, -1 if sheet is None else sheet, None, 0, 0, "name", blank[1], name, *blank[3:], formula, False, False, False)
    if package.date1904:
        yield (workbook_id, -1, None, 0, 0, "1904", *blank[1:], None, False, False, False)


def _cells(frames, context: bool = False):
    import pandas as pd

    columns = [c.split()[0] for c in CELLS.split(", ")]
    for pdf in frames:
        for path, data in zip(pdf["path"], pdf["content"]):
            rows = [*read_context(path, bytes(data))] if context else []
            for row in read_cells(path, bytes(data)):
                rows.append(row)
                if len(rows) == 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)


def _facts(frames):
    import pandas as pd

    for pdf in frames:
        yield pd.DataFrame([read_facts(p, bytes(d)) for p, d in zip(pdf["path"], pdf["content"])], columns=["workbook_id", "sheets", "names", "date1904", "full_calc_on_load", "iterative", "has_calc_chain", "writer"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.cells import shipped

    return shipped(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content"))


def cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the .xlsx files below a path; workbook_id is the file's path."""
    return _files(spark, path).mapInPandas(_cells, CELLS)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """As ``cells``, with rows for the workbooks' defined names and calendars."""
    return _files(spark, path).mapInPandas(lambda frames: _cells(frames, True), CELLS)


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """A row of facts for each .xlsx file below a path."""
    return _files(spark, path).mapInPandas(_facts, FACTS)
