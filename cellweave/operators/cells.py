"""Cell mode: whole workbooks, evaluated side by side.

A workbook is a small irregular graph, so it is the unit of parallelism: cells are grouped by workbook and each group is ordered
and evaluated in one task. Formulas filled down long columns belong to table mode (``table.py``).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..formula.syntax import Call, parse, walk
from ..formula.values import Err, Refusal, address
from ..functions.registry import lookup
from ..functions.scalars import set_number_formatter
from ..sources.xlsx import spread
from .audit import find_hardcoded
from .book import Book

OVERLAY = (
    "workbook_id string, sheet_index int, sheet string, row int, col int, kind string, number double, text string, bool boolean, err string, "
    "formula string, provenance string, code string, subject string, reason string, stale boolean, cached double"
)
FINDINGS = "workbook_id string, sheet string, cell string, stated double, expected double, formula string, axis string, message string"
#: Kinds of rows that are no cells but hold for the whole workbook.
_CONTEXT = ("name", "1904")
_shipped: set[str] = set()
#: Rows of results that are sent on together.
_ROWS = 20_000
_PLACE = ("workbook_id", "sheet_index", "row", "col")


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once the executors' Python can import this package: sent along once for each application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="cellweave-"), "cellweave_formulas.zip")
        with zipfile.ZipFile(base, "w") as out:
            for folder, _, names in sorted(os.walk(top)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(top)))
        context.addPyFile(base)
        _shipped.add(context.applicationId)
    return df


def _value(kind, number, text, flag, err):
    return {"num": lambda: float(number), "text": lambda: text, "bool": lambda: bool(flag), "err": lambda: Err(err)}.get(kind, lambda: None)()


def _present(x):
    """None for pandas' missing values."""
    return None if x is None or x != x else x


def load(pdf, now: float, names=(), date1904: bool = False) -> Book:
    """A workbook from its rows of cells; sheets without cells take part by number only. Rows of kind ``name`` define a name (its
    sheet, or -1), one of kind ``1904`` sets the calendar."""
    kinds = pdf["kind"]
    book = Book(now=now, date1904=date1904 or "1904" in kinds)
    known = {int(i): n for i, n, k in zip(pdf["sheet_index"], pdf["sheet"], kinds) if k not in _CONTEXT}
    names = [*names, *((t, f, None if i < 0 else int(i)) for i, t, f, k in zip(pdf["sheet_index"], pdf["text"], pdf["formula"], kinds) if k == "name")]
    for k in range(max(known, default=-1) + 1):
        book.add_sheet(known.get(k) or f"\0{k}")
    for name, formula, sheet in names:
        book.define_name(name, formula, sheet)
    for s, r, c, kind, number, text, flag, err, formula, has_cache in zip(*(pdf[x] for x in ("sheet_index", "row", "col", "kind", "number", "text", "bool", "err", "formula", "has_cache"))):
        if kind in _CONTEXT:
            continue
        value, formula = _value(kind, number, text, flag, err), _present(formula)
        if formula is None:
            book.set_value(int(s), int(r), int(c), value)
        else:
            book.set_formula(int(s), int(r), int(c), formula, *([value] if _present(has_cache) else []))
    return book


def by_workbook(cells: DataFrame, handle, schema: str) -> DataFrame:
    """``handle`` (a workbook's id and its columns as lists, to rows) for every workbook: one in memory at a time, many to a task."""
    names, kinds = [c.split()[0] for c in schema.split(", ")], [c.split()[1] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        types = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[k] for k in kinds]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        rows: list[tuple] = []
        for book, columns in _books(batches):
            rows += handle(book, columns)
            if len(rows) >= _ROWS:
                yield pack(rows)
                rows = []
        if rows:
            yield pack(rows)

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))  # a number given is not coalesced: cells are slim, work is not
    return shipped(cells).repartition(parts, "workbook_id").sortWithinPartitions("workbook_id").mapInArrow(run, schema)


def _books(batches):
    """Each workbook's id and columns, from batches sorted by workbook."""
    book, held, some = None, {}, False
    for batch in batches:
        columns = batch.to_pydict()
        ids = columns["workbook_id"]
        at = 0
        while at < len(ids):
            if not some or ids[at] != book:
                if some:
                    yield book, held
                book, some, held = ids[at], True, {c: [] for c in columns}
            end = at
            while end < len(ids) and ids[end] == book:
                end += 1
            for c, values in columns.items():
                held[c] += values[at:end]
            at = end
    if some:
        yield book, held


def _evaluated(workbook, columns, now: float, names, formatted: bool, prefer_cached: bool, date1904: bool) -> list[tuple]:
    from ..functions.formats import format_number

    set_number_formatter(format_number if formatted else None)
    book = load(columns, now, names, date1904)
    book.evaluate_all()
    stale = set(book.mismatched())
    rows = []
    for (s, r, c), x in sorted(book.cells.items()):
        value = x.cached if prefer_cached and x.provenance == "volatile" and x.has_cache else x.value
        shown = spread({"err": value.kind} if isinstance(value, Err) else value)
        if x.provenance in ("unsupported", "circular"):
            shown = spread(None)  # never a number
        rows.append((workbook, s, book.sheets[s], r, c, *shown, x.formula, x.provenance, x.code, x.subject, x.reason, (s, r, c) in stale, x.cached if x.has_cache and isinstance(x.cached, float) else None))
    return rows


def evaluate_workbooks(cells: DataFrame, names: dict | None = None, now: float = 0.0, formatted: bool = True, prefer_cached_volatile: bool = True, date1904: frozenset[str] = frozenset()) -> DataFrame:
    """The overlay: each cell's value, provenance and, where it has none, the reason. ``names`` maps workbook_id to its
    (name, formula, sheet number or None) triples, beside those among the rows (``xlsx.contents``). ``now`` is the frozen clock as
    a serial; ``date1904`` are the ids of workbooks that count days from 1904."""
    names = names or {}
    handle = lambda workbook, columns: _evaluated(workbook, columns, now, names.get(workbook, ()), formatted, prefer_cached_volatile, workbook in date1904)
    return by_workbook(cells, handle, OVERLAY)


def evaluate_files(spark, path: str, now: float = 0.0) -> DataFrame:
    """The overlay of all .xlsx files below a path, with their defined names and calendars, which come along as rows."""
    from ..sources import xlsx

    return evaluate_workbooks(xlsx.contents(spark, path), now=now)


def provenance_counts(overlay: DataFrame) -> DataFrame:
    """workbook_id, provenance and number of cells; stale counts computed cells that disagree with the file."""
    return overlay.groupBy("workbook_id", "provenance").agg(F.count(F.lit(1)).alias("cells"), F.count_if("stale").alias("stale"))


def gaps(overlay: DataFrame) -> DataFrame:
    """What was not computed, by code and subject: how often, and one place."""
    place = F.concat(F.col("sheet"), F.lit("!r"), F.col("row"), F.lit("c"), F.col("col"))
    return overlay.filter("code is not null").groupBy("code", "subject").agg(F.count(F.lit(1)).alias("cells"), F.min(place).alias("sample"))


def hardcoded(cells: DataFrame, now: float = 0.0, most: int | None = None) -> DataFrame:
    """Typed numbers that contradict the formulas around them; of each workbook ``most`` at most, all of them by default."""

    def handle(workbook, columns):
        book = load(columns, now)
        book.evaluate_all()
        return [(workbook, book.sheets[f.sheet], address(f.row, f.col), f.stated, f.expected, f.formula, f.axis, f.describe(book)) for f in find_hardcoded(book, most)]

    return by_workbook(cells, handle, FINDINGS)


def _uses(frames):
    import pandas as pd

    for pdf in frames:
        rows = []
        for *place, formula in zip(*(pdf[c] for c in _PLACE), pdf["formula"]):
            try:
                for node in walk(parse(formula)):
                    if isinstance(node, Call):
                        f = lookup(node.name)
                        rows.append((*place, node.name, f is not None and f.refused is None, None if f is None else f.refused))
            except Refusal as r:
                rows.append((*place, f"[{r.code}]", False, r.message))
        yield pd.DataFrame(rows, columns=[*_PLACE, "function", "supported", "reason"])


def function_uses_by_cell(cells: DataFrame) -> DataFrame:
    """A row for each call in a formula: its cell, function, supported and reason."""
    formulas = shipped(cells.filter((F.col("formula").isNotNull()) & ~F.col("kind").isin(*_CONTEXT)).select(*_PLACE, "formula"))
    return formulas.mapInPandas(_uses, "workbook_id string, sheet_index int, row int, col int, function string, supported boolean, reason string")


def function_uses(cells: DataFrame) -> DataFrame:
    """Functions by use, from parsing alone: workbook_id, function, supported, reason and uses. Refusals at parse are named
    by their code in brackets. What depends on an unsupported cell is not counted: a floor."""
    return function_uses_by_cell(cells).groupBy("workbook_id", "function", "supported", "reason").agg(F.count(F.lit(1)).alias("uses"))


def precedents(cells: DataFrame, most: int | None = None) -> DataFrame:
    """Each formula cell and the cells it reads directly; ``most`` of a cell at most, all of them by default."""

    def handle(workbook, columns):
        book = load(columns, 0.0)
        return [(workbook, s, r, c, *read) for (s, r, c), x in book.cells.items() if x.formula for read in book.precedents(s, r, c, most)]

    return by_workbook(cells, handle, "workbook_id string, sheet_index int, row int, col int, reads_sheet int, reads_row int, reads_col int")


def inspect_workbooks(cells: DataFrame) -> DataFrame:
    """From parsing alone: workbook_id, cells, formulas, array and shared ones, uncached (formulas without a stored value), unsupported (formulas
    that cannot be computed: a floor, as what depends on them is not counted) and fully_covered."""
    uses = function_uses_by_cell(cells)
    refused = uses.filter(~F.col("supported")).select("workbook_id", "sheet_index", "row", "col").distinct().groupBy("workbook_id").agg(F.count(F.lit(1)).alias("unsupported"))
    own = cells.filter(~F.col("kind").isin(*_CONTEXT))
    formula = F.col("formula").isNotNull()
    counted = own.groupBy("workbook_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(formula).alias("formulas"), F.count_if(formula & F.col("array_formula")).alias("array_formulas"),
        F.count_if(formula & F.col("from_shared")).alias("shared_formulas"), F.count_if(formula & ~F.col("has_cache")).alias("uncached"),
    )
    return counted.join(refused, "workbook_id", "left").withColumn("unsupported", F.coalesce("unsupported", F.lit(0))).withColumn("fully_covered", F.col("unsupported") == 0)
