"""Table mode: a formula filled down a column becomes a column of a DataFrame.

A Sheet names a DataFrame's columns by letters. Formulas are written as they stand in one row, row 1 unless ``base`` says
another: in row 2's formula ``A2`` is this row's A and ``A1`` the row's before. Supported shapes: this row's cells, cells of
rows around, running ranges ``$A$1:A1``, sliding ranges (windows over numbered blocks of rows, with the rows around them),
whole columns ``A:A`` (an aggregate, used as a scalar subquery or joined by group), conditional aggregates whose criteria
are this row's cells (an aggregate by key and a left join), and lookups in whole columns (a join). An error value in a range
is the result, the first in the order of rows. Anything else is refused, as a cell would be.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..formula.syntax import Binary, Call, Lit, Missing, Percent, Ref, Unary, parse, rebuilt, unparse, walk
from ..formula.values import Err, Refusal, column_name
from ..functions.aggregates import split_criterion
from ..functions.columns import COMPILERS, Typed, _fault, _lit, arithmetic, boolean, compared, error_of, finite, guarded, letting, number, parsed_number, text
from ..functions.library import lookup
from ..functions.scalars import has_wildcard
from .ordered import approximate_lookup, numbered, order_key, unsorted

_KINDS = {"double": "num", "float": "num", "int": "num", "bigint": "num", "smallint": "num", "tinyint": "num", "string": "text", "boolean": "bool"}
_AGGREGATES = {
    "SUM": F.sum, "COUNT": F.count, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max, "SUMSQ": lambda c: F.sum(c * c), "PRODUCT": F.product, "MEDIAN": F.median,
    "STDEV": F.stddev_samp, "STDEV.S": F.stddev_samp, "STDEV.P": F.stddev_pop, "STDEVP": F.stddev_pop, "VAR": F.var_samp, "VAR.S": F.var_samp, "VAR.P": F.var_pop, "VARP": F.var_pop,
}
#: The error of an aggregate of nothing, where it is not 0.
_EMPTY = {"AVERAGE": "#DIV/0!", "MEDIAN": "#NUM!", **{k: "#DIV/0!" for k in ("STDEV", "STDEV.S", "STDEV.P", "STDEVP", "VAR", "VAR.S", "VAR.P", "VARP")}}
_OF_NOTHING_0 = ("SUM", "MIN", "MAX", "SUMSQ", "PRODUCT")
#: Whole-column aggregates that need the order of values, and those of two columns.
_RANKED = ("LARGE", "SMALL", "PERCENTILE", "PERCENTILE.INC", "PERCENTILE.EXC", "QUARTILE", "QUARTILE.INC", "QUARTILE.EXC", "MEDIAN")
_PAIRED = ("CORREL", "RSQ", "SLOPE", "INTERCEPT", "FORECAST", "FORECAST.LINEAR")
_SUMMARIES = (*_AGGREGATES, *_RANKED, *_PAIRED, "COUNTA", "COUNTBLANK", "AVERAGEA", "MINA", "MAXA", "AND", "OR", "XOR", "SUBTOTAL", "SUMPRODUCT", "NPV", "XNPV", "MIRR")
#: SUBTOTAL's codes (2 and 3 count numbers).
_SUBTOTAL = {1: "AVERAGE", 2: "COUNT", 3: "COUNT", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV", 8: "STDEV.P", 9: "SUM", 10: "VAR", 11: "VAR.P"}
_LOOKUPS = ("VLOOKUP", "XLOOKUP", "LOOKUP", "MATCH", "XMATCH", "INDEX")
#: Criteria and patterns of rows that are more than plain values are met one by one with the different values of their ranges: at most so
#: many different ones, or the formula is refused.
MOST_ODD = 1000
#: LARGE and SMALL of up to so many are a sorted limit where there are no groups; beyond, and in groups, places in buckets give them.
MOST_TOP = 10_000
#: Rows of a window block; a block also holds the rows around it that its own rows look at.
WINDOW_ROWS = 200_000
_CONDITIONAL = {"SUMIFS": "SUM", "AVERAGEIFS": "AVERAGE", "MAXIFS": "MAX", "MINIFS": "MIN", "COUNTIFS": "COUNT", "SUMIF": "SUM", "AVERAGEIF": "AVERAGE", "COUNTIF": "COUNT"}
#: Names with a table form of their own, beside those of single cells in ``COMPILERS``.
FORMS = {*_SUMMARIES, *_CONDITIONAL, *_LOOKUPS, "RANK", "RANK.EQ", "TODAY", "NOW", "ISREF", "ROWS", "COLUMN", "COLUMNS", "AREAS"}


def _aggregated(name: str, x: Column, window=None) -> Column:
    found = _AGGREGATES[name](x) if window is None else _AGGREGATES[name](x).over(window)
    return F.coalesce(found, F.lit(0.0)) if name in _OF_NOTHING_0 else found


def _first_error(error: Column, order: list[str]) -> Column:
    """The error of the first row that has one; without an order the least one."""
    return F.min_by(error, F.when(error.isNotNull(), F.struct(*[F.col(f"`{o}`") for o in order]))) if order else F.min(error)


def _is_column(node) -> bool:
    return isinstance(node, Ref) and node.shape == "cols" and node.left == node.right


def _whole(number: object, what: str) -> int:
    if not isinstance(number, (int, float)):
        raise Refusal("ARG_UNSUPPORTED", f"{what} must be a constant to have a column form", what)
    return math.trunc(float(number))


def _constant(node) -> object:
    """The value of a literal, signed or in percent; None of anything else."""
    match node:
        case Lit(v):
            return v
        case Unary(op, x) if isinstance(n := _constant(x), (int, float)):
            return -n if op == "-" else n
        case Percent(x) if isinstance(n := _constant(x), (int, float)):
            return n / 100
        case Call(("TRUE" | "FALSE") as name, ()):
            return name == "TRUE"
    return None


@dataclass
class Sheet:
    """``columns`` maps letters to column names; ``order`` (columns that order the rows) is needed by shapes that look at
    other rows, ``within`` splits the rows into sheets of their own; ``cells`` gives fixed cells such as ``$B$4``; ``now`` pins the clock.
    Rows should differ in their order columns; rows that share the first one's value stay together in a task."""

    df: DataFrame
    columns: dict[str, str]
    order: list[str] = field(default_factory=list)
    within: list[str] = field(default_factory=list)
    cells: dict[str, object] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    others: dict[str, "Sheet"] = field(default_factory=dict)
    base: int = 1
    now: float | None = None
    found: dict = field(default_factory=dict)
    blocks: tuple = ()
    placed: dict = field(default_factory=dict, repr=False, compare=False)

    # ---- columns

    def _named(self, col: int) -> str:
        letter = column_name(col)
        if letter not in self.columns:
            raise Refusal("REF_SHAPE", f"column {letter} is not bound", letter)
        return self.columns[letter]

    def _kind(self, name: str) -> str:
        kind = dict(self.df.dtypes)[name]
        return "num" if kind.startswith("decimal") else _KINDS.get(kind) or self._refuse(name, kind)

    @staticmethod
    def _refuse(name: str, kind: str):
        raise Refusal("FEATURE", f"column {name} of type {kind} is no spreadsheet value", name)

    def _column(self, name: str) -> Typed:
        kind, c = self._kind(name), F.col(f"`{name}`")
        error = F.col(f"`{self.errors[name]}`") if name in self.errors else None
        return Typed(c.cast("double") if kind == "num" else c, kind, error)

    def _window(self):
        self._ordered()
        if self.blocks:
            return Window.partitionBy("_block").orderBy("_n")
        if not self.within:
            raise Refusal("REF_SHAPE", "this shape needs its rows numbered first: add it as a column", "order")
        return Window.partitionBy(*self.within).orderBy(*self.order)

    def _ordered(self) -> list[str]:
        if not self.order:
            raise Refusal("REF_SHAPE", "this shape needs an order of rows", "order")
        return self.order

    def _source(self, ref: Ref) -> "Sheet":
        if ref.sheet is None:
            return self
        if ref.sheet not in self.others:
            raise Refusal("REF_SHAPE", f"sheet {ref.sheet} is not bound", ref.sheet)
        return self.others[ref.sheet]

    # ---- compiling

    def compile(self, formula: str) -> Typed:
        """The formula as a column; raises Refusal where it cannot be one."""
        return self._tree(parse(formula))

    def _tree(self, node) -> Typed:
        match node:
            case Lit(v):
                return _fault(v.kind) if isinstance(v, Err) else _lit(v)
            case Ref(shape="cell"):
                return self._cell(node)
            case Unary("-", x):
                n = number(self._tree(x))
                return finite(-n.value, n) if n.constant is None else _lit(-float(n.constant))
            case Unary(_, x):
                return self._tree(x)
            case Percent(x):
                n = number(self._tree(x))
                return finite(n.value / 100, n)
            case Binary("&", l, r):
                a, b = text(self._tree(l)), text(self._tree(r))
                return guarded(F.concat(a.value, b.value), "text", a, b)
            case Binary(op, l, r) if op in "+-*/^":
                return arithmetic(op, self._tree(l), self._tree(r))
            case Binary(op, l, r):
                return compared(op, self._tree(l), self._tree(r))
            case Call(name, args):
                return self._call(name, args)
        raise Refusal("REF_SHAPE", f"{unparse(node)} has no column form", unparse(node))

    def _cell(self, ref: Ref) -> Typed:
        if ref.fixed[0] and ref.fixed[1]:
            key = f"${column_name(ref.left)}${ref.top}"
            if key not in self.cells:
                raise Refusal("REF_SHAPE", f"fixed cell {key} is not bound", key)
            return _lit(self.cells[key])
        t = self._column(self._named(ref.left))
        if ref.top == self.base:
            return t
        away = ref.top - self.base
        return Typed(F.lead(t.value, away).over(self._window()), t.kind, None if t.error is None else F.lead(t.error, away).over(self._window()))

    def _call(self, name: str, args) -> Typed:
        if (known := self.found.get(Call(name, tuple(args)))) is not None:
            return known
        f = lookup(name)
        if f is None:
            raise Refusal("FN_UNKNOWN", f"{name} is not a known function", name)
        if f.refused:
            raise Refusal("FN_UNIMPLEMENTED", f.refused, name)
        if len(args) < f.least or f.most >= 0 and len(args) > f.most:
            return _fault("#VALUE!")
        if name in ("TODAY", "NOW"):
            if self.now is None:
                raise Refusal("ARG_UNSUPPORTED", f"{name} needs a pinned clock", name)
            return _lit(float(math.floor(self.now)) if name == "TODAY" else float(self.now))
        if name == "ISREF" and len(args) == 1:
            return _lit(isinstance(args[0], Ref))
        if name in ("ROWS", "COLUMNS", "AREAS") and isinstance(args[0], Ref):
            ref = args[0]
            return _lit(float({"ROWS": ref.bottom - ref.top, "COLUMNS": ref.right - ref.left, "AREAS": 0}[name] + 1))
        if name == "COLUMN" and len(args) == 1 and isinstance(args[0], Ref):
            return _lit(float(args[0].left))
        if name in _SUMMARIES and any(isinstance(n, Ref) and n.shape == "cols" for a in args for n in walk(a)):
            return self._summarised(name, args)
        if name in _AGGREGATES and len(args) == 1 and isinstance(args[0], Ref) and args[0].shape != "cell":
            return self._aggregate(name, args[0])
        if name in _AGGREGATES or name in ("AND", "OR", "XOR"):
            return self._row_aggregate(name, [(isinstance(a, Ref), self._tree(a)) for a in args if not isinstance(a, Missing)])
        if name == "NPV":
            return self._row_npv(self._tree(args[0]), [(isinstance(a, Ref), self._tree(a)) for a in args[1:] if not isinstance(a, Missing)])
        if name not in COMPILERS:
            raise Refusal("ARG_UNSUPPORTED", f"{name} has no column form", name)
        return COMPILERS[name](*[Typed(F.lit(None).cast("double"), "num") if isinstance(a, Missing) else self._tree(a) for a in args])

    @staticmethod
    def _row_aggregate(name: str, xs: list[tuple[bool, Typed]]) -> Typed:
        """Aggregates of values given one by one: what is not a number is not seen in a cell, and coerced if given directly."""
        logical = name in ("AND", "OR", "XOR")
        seen, errors = [], []
        for cell, x in xs:
            errors.append(x.error)
            if cell and (x.kind == "num" or logical and x.kind == "bool"):
                seen.append(x.value if x.kind == "num" else x.value.cast("double"))
            elif not cell:
                t = boolean(x) if logical else number(x)
                errors.append(t.error)
                seen.append(t.value.cast("double"))
        here = [F.when(v.isNotNull(), 1).otherwise(0) for v in seen]
        n = sum(here[1:], here[0]) if here else F.lit(0)
        add = lambda vs: sum(vs[1:], vs[0]) if vs else F.lit(0.0)
        if logical:
            true = add([F.when(v != 0, 1).otherwise(0) for v in seen])
            return guarded({"AND": true == n, "OR": true > 0, "XOR": true % 2 == 1}[name], "bool", *errors, F.when(n == 0, "#VALUE!"))
        total = add([F.coalesce(v, F.lit(0.0)) for v in seen])
        if name == "COUNT":
            return Typed(n.cast("double"), "num")
        if name == "AVERAGE":
            return finite(F.try_divide(total, n), *errors, F.when(n == 0, "#DIV/0!"))
        if name in ("MIN", "MAX"):
            some = [*seen, F.lit(None).cast("double"), F.lit(None).cast("double")]
            return finite(F.coalesce((F.least if name == "MIN" else F.greatest)(*some), F.lit(0.0)), *errors)
        if name == "PRODUCT":
            product = F.lit(1.0)
            for v in seen:
                product = product * F.coalesce(v, F.lit(1.0))
            return finite(F.when(n == 0, 0.0).otherwise(product), *errors)
        if name in ("SUM", "SUMSQ"):
            return finite(total if name == "SUM" else add([F.coalesce(v * v, F.lit(0.0)) for v in seen]), *errors)
        raise Refusal("ARG_UNSUPPORTED", f"{name} of single cells has no column form", name)

    @staticmethod
    def _row_npv(rate: Typed, xs: list[tuple[bool, Typed]]) -> Typed:
        """Flows of this row; cells without a number are left out and take no period."""
        r, total, period, errors = number(rate), F.lit(0.0), F.lit(0), []
        for cell, x in xs:
            if cell and x.kind != "num":
                errors.append(x.error)
                continue
            t = x if cell else number(x)
            errors.append(t.error)
            period = period + F.when(t.value.isNotNull(), 1).otherwise(0)
            total = total + F.coalesce(F.try_divide(t.value, F.pow(1 + r.value, period)), F.lit(0.0))
        return finite(total, r, *errors, F.when(r.value == -1, "#DIV/0!"))

    def _aggregate(self, name: str, ref: Ref) -> Typed:
        """Of rows around this one: a window, with the first error that it holds."""
        if ref.left != ref.right:
            raise Refusal("REF_SHAPE", "ranges of several columns have no column form", unparse(ref))
        if ref.sheet:
            raise Refusal("REF_SHAPE", "rows around this one are of this sheet", unparse(ref))
        t = self._column(self._named(ref.left))
        x = t.value if t.kind == "num" else F.lit(None).cast("double")
        if not ref.fixed[0] and not ref.fixed[2]:
            window = self._window().rowsBetween(ref.top - self.base, ref.bottom - self.base)
        elif ref.fixed[0] and not ref.fixed[2] and self.within and not self.blocks:
            window = self._window().rowsBetween(Window.unboundedPreceding, ref.bottom - self.base)
        else:
            raise Refusal("REF_SHAPE", f"{unparse(ref)} has no column form here", unparse(ref))
        error = None if t.error is None or name == "COUNT" else F.first(t.error, ignorenulls=True).over(window)
        return self._closed(name, _aggregated(name, x, window).cast("double"), error)

    @staticmethod
    def _closed(name: str, value: Column, *errors) -> Typed:
        empty = F.when(value.isNull(), _EMPTY[name]) if name in _EMPTY else None
        return Typed(value, "num") if name == "COUNT" else finite(value, *errors, empty)

    # ---- whole columns

    def _summarised(self, name: str, args) -> Typed:
        """A whole-column aggregate as a scalar subquery of one row, evaluated once."""
        source, plan, kind, open_error = self._summary(name, args)
        if source.within:
            raise Refusal("REF_SHAPE", "an aggregate within groups needs a join: add it as a column", name)
        s = source._made(plan).select(F.struct("value", "error")).scalar()
        return self._opened(name, args, guarded(s["value"], kind, s["error"] if open_error else None))

    def _opened(self, name: str, args, t: Typed) -> Typed:
        """FORECAST's aggregate is the line; its point is this row's."""
        if not name.startswith("FORECAST"):
            return t
        x = number(self._tree(args[0]))
        return finite(t.value["cut"] + t.value["slope"] * x.value, x, t)

    def _made(self, plan) -> DataFrame:
        """A row for each group: value and error."""
        if isinstance(plan, DataFrame):
            return plan
        columns, value, error = plan
        return self._rows(columns).groupBy(*[f"`{g}`" for g in self.within]).agg(value.alias("value"), error.alias("error"))

    def _rows(self, columns: dict[str, Column | None]) -> DataFrame:
        """Groups, order and some columns made from the sheet's, under names of their own."""
        keep = list(dict.fromkeys([*self.within, *self.order]))
        if clash := set(columns) & set(keep):
            raise Refusal("FEATURE", f"columns named {sorted(clash)} cannot order or group rows here", "name")
        return self.df.select(*[F.col(f"`{c}`") for c in keep], *[(F.lit(None).cast("string") if c is None else c).alias(k) for k, c in columns.items()])

    def _summary(self, name: str, args, tag: str = ""):
        """(sheet, plan, the value's kind, whether errors can arise); a plan is a DataFrame with a row for each group, or columns of the
        sheet and the value and error that one aggregation makes of them (``tag`` tells such columns apart)."""
        if name == "SUBTOTAL":
            code = _whole(_constant(args[0]), "SUBTOTAL")
            if 101 <= code <= 111:
                raise Refusal("ARG_UNSUPPORTED", "SUBTOTAL over visible rows needs to know which rows are hidden", "SUBTOTAL")
            if code not in _SUBTOTAL:
                raise Refusal("ARG_UNSUPPORTED", f"SUBTOTAL code {code}", "SUBTOTAL")
            return self._summary(_SUBTOTAL[code], args[1:], tag)
        refs = [n for a in args for n in walk(a) if isinstance(n, Ref) and n.shape == "cols"]
        if len({r.sheet for r in refs}) != 1 or any(r.left != r.right for r in refs):
            raise Refusal("REF_SHAPE", "whole columns must be single ones of one sheet", name)
        source = self._source(refs[0])
        groups, order = source.within, source.order
        rowwise = replace(source, base=1, found={}, blocks=())
        one = lambda n: Ref(None, 1, n.left, 1, n.left, (False,) * 4) if isinstance(n, Ref) and n.shape == "cols" else n
        x_, y_, e_, ex_, ey_ = (f"_{k}{tag}" for k in ("x", "y", "e", "ex", "ey"))
        if name == "SUMPRODUCT":
            total, errors = F.lit(1.0), []
            for a in args:
                t = rowwise._tree(rebuilt(a, one))
                errors.append(t.error)
                total = total * (F.coalesce(t.value.cast("double"), F.lit(0.0)) if t.kind in ("num", "bool") else F.lit(0.0))
            return source, ({x_: total, e_: error_of(*errors)}, F.coalesce(F.sum(x_), F.lit(0.0)), _first_error(F.col(e_), order)), "num", True
        if name in _PAIRED:
            pair = args[1:] if name.startswith("FORECAST") else args
            if len(pair) != 2 or not all(map(_is_column, pair)):
                raise Refusal("REF_SHAPE", f"{name} takes two whole columns here", name)
            y, x = (rowwise._column(rowwise._named(a.left)) for a in pair)
            known = y.value.isNotNull() & x.value.isNotNull() if y.kind == x.kind == "num" else F.lit(False)
            columns = {y_: F.when(known, y.value.cast("double")), x_: F.when(known, x.value.cast("double")), ey_: y.error, ex_: x.error}
            m = F.regr_slope(y_, x_)
            value = {"CORREL": F.corr(y_, x_), "RSQ": F.pow(F.corr(y_, x_), 2), "SLOPE": m, "INTERCEPT": F.regr_intercept(y_, x_)}.get(name, F.struct(m.alias("slope"), F.regr_intercept(y_, x_).alias("cut")))
            flat = (F.coalesce(F.var_pop(x_), F.lit(0.0)) == 0) | ((F.coalesce(F.var_pop(y_), F.lit(0.0)) == 0) if name in ("CORREL", "RSQ") else F.lit(False))
            error = F.coalesce(_first_error(F.col(ey_), order), _first_error(F.col(ex_), order), F.when(flat, "#DIV/0!"))
            return source, (columns, value, error), "num", True
        if name in ("NPV", "MIRR"):
            return source, source._flows(name, args, rowwise), "num", True
        if name == "XNPV":
            rate = self._rates(name, args[:1])[0]
            if not all(map(_is_column, args[1:])):
                raise Refusal("REF_SHAPE", "XNPV takes two whole columns here", name)
            source._ordered()
            v, d = (rowwise._column(rowwise._named(a.left)) for a in args[1:])
            if d.kind != "num":
                raise Refusal("ARG_UNSUPPORTED", "XNPV's dates must be numbers to have a column form", name)
            flow = v.value if v.kind == "num" else F.lit(None).cast("double")
            day = F.floor(F.coalesce(d.value, F.lit(0.0))).cast("double")
            columns = {x_: flow, y_: day, e_: F.coalesce(error_of(v, d, F.when(flow.isNull(), "#VALUE!")), F.when(day < 0, "#NUM!"))}
            first = F.min_by(F.col(y_), F.struct(*[F.col(f"`{o}`") for o in order]))
            value = F.pow(F.lit(1 + rate), first / 365) * F.sum(F.col(x_) * F.pow(F.lit(1 + rate), -F.col(y_) / 365)) if rate > -1 else F.max(F.lit(None).cast("double"))
            bad = F.when((F.count(F.lit(1)) == 0) | (F.min(y_) < first) | F.lit(rate <= -1), "#NUM!")
            return source, (columns, value, F.coalesce(_first_error(F.col(e_), order), bad, F.when(F.isnan(value) | (F.abs(value) == math.inf), "#NUM!"))), "num", True
        if not _is_column(args[0]):
            raise Refusal("REF_SHAPE", f"{name} has a column form over one whole column", name)
        if len(args) != (2 if name in _RANKED and name != "MEDIAN" else 1):
            raise Refusal("ARG_UNSUPPORTED", f"{name} of several arguments has no column form", name)
        t = rowwise._column(rowwise._named(args[0].left))
        seen = t.value if t.kind == "num" else F.lit(None).cast("double")
        if name in ("COUNTA", "COUNTBLANK"):
            held = t.value.isNotNull() | (t.error.isNotNull() if t.error is not None else F.lit(False))
            blank = ~held if t.kind != "text" else ~held | F.coalesce(t.value == "", F.lit(False))
            return source, ({x_: held if name == "COUNTA" else blank}, F.count_if(x_).cast("double"), F.max(F.lit(None).cast("string"))), "num", False
        if name in ("AND", "OR", "XOR"):
            truth = t.value if t.kind == "bool" else t.value != 0 if t.kind == "num" else F.lit(None).cast("boolean")
            value = {"AND": F.bool_and(x_), "OR": F.bool_or(x_), "XOR": F.count_if(x_) % 2 == 1}[name]
            return source, ({x_: truth, e_: t.error}, value, F.coalesce(_first_error(F.col(e_), order), F.when(F.count(x_) == 0, "#VALUE!"))), "bool", True
        if name in ("AVERAGEA", "MINA", "MAXA"):
            seen = F.when(t.value.isNotNull(), 0.0) if t.kind == "text" else t.value.cast("double")
            name = name[:-1] if name != "AVERAGEA" else "AVERAGE"
        k = _constant(args[1]) if name in ("LARGE", "SMALL") else None
        if not groups and isinstance(k, (int, float)) and 1 <= math.ceil(k) <= MOST_TOP:
            k = math.ceil(k)  # a bounded top-k
            few = source._rows({x_: seen}).filter(F.col(x_).isNotNull()).orderBy(F.col(x_).desc() if name == "LARGE" else F.col(x_)).limit(k)
            got = few.agg(F.when(F.count(x_) == k, (F.min if name == "LARGE" else F.max)(x_)).alias("value"))
            bad = source._rows({e_: t.error}).agg(_first_error(F.col(e_), order).alias("first")).select("first").scalar() if t.error is not None else F.lit(None).cast("string")
            return source, got.select("value", F.coalesce(bad, F.when(F.col("value").isNull(), "#NUM!")).alias("error")), "num", True
        if name in _RANKED:
            return source, self._ranked_summary(name, source._rows({"_x": seen, "_e": t.error}), args, groups, order), "num", True
        value = _aggregated(name, F.col(x_)).cast("double")
        error = F.max(F.lit(None).cast("string")) if name == "COUNT" else F.coalesce(_first_error(F.col(e_), order), F.when(value.isNull(), _EMPTY[name]) if name in _EMPTY else F.lit(None).cast("string"), F.when(F.isnan(value) | (F.abs(value) == math.inf), "#NUM!"))
        return source, ({x_: seen, e_: t.error}, value, error), "num", name != "COUNT"

    @staticmethod
    def _rates(name: str, args) -> list[float]:
        rates = [_constant(a) for a in args]
        if not all(isinstance(r, (int, float)) for r in rates):
            raise Refusal("ARG_UNSUPPORTED", f"{name}'s rates must be constants to have a column form", name)
        return [float(r) for r in rates]

    def _flows(self, name: str, args, rowwise: "Sheet") -> DataFrame:
        """NPV and MIRR of the numbers of a column in the order of rows: numbered in buckets, then one sum for each group."""
        column = args[1 if name == "NPV" else 0]
        if not _is_column(column) or name == "NPV" and len(args) != 2:
            raise Refusal("REF_SHAPE", f"{name} has a column form over one whole column", name)
        rates = self._rates(name, args[:1] if name == "NPV" else args[1:])
        self._ordered()
        t = rowwise._column(rowwise._named(column.left))
        rows = self._rows({"_x": t.value if t.kind == "num" else F.lit(None).cast("double"), "_e": t.error})
        keys, x, k = [F.col(f"`{g}`") for g in self.within], F.col("_x"), F.col("_place").cast("double")
        wanted = rows.groupBy(*[c.alias(f"_t{i}") for i, c in enumerate(keys)]).agg(_first_error(F.col("_e"), self.order).alias("_first"))
        known = (id(self.df), rowwise._named(column.left), *self.order, None, *self.within)  # formulas of one column share its numbering
        if known not in self.placed:
            self.placed[known] = (self.df, numbered(rows.filter("_x is not null"), self.order, "_place", self.within))
        placed = self.placed[known][1]
        growth = [F.lit(1 + r) for r in rates]
        if -1 in rates:
            value, bad = F.max(F.lit(None).cast("double")), F.lit(True)
        elif name == "NPV":
            value, bad = F.sum(x * F.pow(growth[0], -(k + 1))), F.lit(False)
        else:
            m = F.count("_x").cast("double")
            gains = F.sum(F.when(x > 0, x * F.pow(growth[1], -k))) * F.pow(growth[1], m - 1)
            value = F.pow(F.try_divide(gains, -F.sum(F.when(x < 0, x * F.pow(growth[0], -k)))), F.try_divide(F.lit(1.0), m - 1)) - 1
            bad = (m < 2) | (F.count_if(x > 0) == 0) | (F.count_if(x < 0) == 0)
        sums = placed.groupBy(*[c.alias(f"_u{i}") for i, c in enumerate(keys)]).agg(value.alias("value"), bad.alias("_bad"))
        met = wanted.join(sums, [F.col(f"_t{i}").eqNullSafe(F.col(f"_u{i}")) for i in range(len(keys))], "left") if keys else wanted.join(sums)
        value = F.col("value") if name == "MIRR" else F.coalesce("value", F.when(~F.coalesce("_bad", F.lit(-1 in rates)), 0.0))  # no numbers: 0
        fault = F.when(F.coalesce("_bad", F.lit(name == "MIRR" or -1 in rates)), "#DIV/0!").when(F.isnan(value) | (F.abs(value) == math.inf), "#NUM!")
        # a rate of -1 is a fault before any flow is looked at
        error = fault if name == "NPV" and -1 in rates else F.coalesce("_first", fault)
        return met.select(*[F.col(f"_t{i}").alias(g) for i, g in enumerate(self.within)], F.when(error.isNull(), value).alias("value"), error.alias("error"))

    def summary(self, formulas: dict[str, str]) -> DataFrame:
        """A row for each group of ``within``, or one row: a column for each formula over whole columns, and ``name_error`` beside it
        where errors can arise. All aggregates that need no order of values come from one aggregation."""
        trees, found, plain, later = {n: parse(f) for n, f in formulas.items()}, {}, {}, []
        for tree in trees.values():
            for node in walk(tree):
                if isinstance(node, Call) and node.name in _SUMMARIES and node not in found and any(isinstance(n, Ref) and n.shape == "cols" and n.sheet is None for n in walk(node)):
                    k = len(found)
                    _, plan, kind, open_error = self._summary(node.name, node.args, str(k))
                    if isinstance(plan, DataFrame):
                        later.append((k, plan))
                    else:
                        plain[k] = plan
                    found[node] = guarded(F.col(f"_s{k}"), kind, F.col(f"_t{k}") if open_error else None)
        rows = self._rows({c: x for columns, _, _ in plain.values() for c, x in columns.items()})
        df = rows.groupBy(*[F.col(f"`{g}`") for g in self.within]).agg(F.count(F.lit(1)).alias("_n"), *[x.alias(f"_{c}{k}") for k, (_, value, error) in plain.items() for c, x in (("s", value), ("t", error))])
        for k, plan in later:
            plan = plan.select(*[F.col(f"`{g}`").alias(f"_q{i}") for i, g in enumerate(self.within)], F.col("value").alias(f"_s{k}"), F.col("error").alias(f"_t{k}"))
            df = (df.join(plan, [F.col(f"`{g}`").eqNullSafe(F.col(f"_q{i}")) for i, g in enumerate(self.within)]) if self.within else df.join(plan)).drop(*[f"_q{i}" for i in range(len(self.within))])
        out, made = Sheet(df, {}, cells=self.cells, others=self.others, now=self.now), {}
        out.found = {node: out._opened(node.name, node.args, t) for node, t in found.items()}
        for name, tree in trees.items():
            t = out._tree(tree)
            made[name] = F.lit(None).cast("double") if t.kind == "err" else t.value
            if t.error is not None:
                made[f"{name}_error"] = t.error
        return df.select(*[F.col(f"`{g}`") for g in self.within], *[c.alias(n) for n, c in made.items()])

    @staticmethod
    def _ranked_summary(name: str, rows: DataFrame, args, groups: list[str], order: list[str]) -> DataFrame:
        """Order statistics by the places of values in buckets: no group of values is ever in one task."""
        k = 0.5 if name == "MEDIAN" else _constant(args[1])
        if not isinstance(k, (int, float)):
            raise Refusal("ARG_UNSUPPORTED", f"{name}'s second argument must be a constant to have a column form", name)
        keys = [F.col(f"`{g}`") for g in groups]
        totals = rows.groupBy(*keys).agg(F.count("_x").cast("double").alias("_m"), _first_error(F.col("_e"), order).alias("_first"))
        m = F.col("_m")
        if name in ("LARGE", "SMALL"):
            k = math.ceil(k)
            at, bad = (m - k if name == "LARGE" else F.lit(float(k - 1))), (m < k) if k >= 1 else F.lit(True)
        else:
            exclusive = name.endswith(".EXC")
            if name.startswith("QUARTILE"):
                k = math.trunc(k) / 4
            at = (m + 1) * k - 1 if exclusive else (m - 1) * k
            outside = ((m * k + k < 1) | (k * (m + 1) > m)) if exclusive else F.lit(False)
            bad = (m == 0) | outside | F.lit(not 0 <= k <= 1)
        low = F.greatest(F.floor(at), F.lit(0)).cast("double")
        placed = numbered(rows.filter("_x is not null").select(*keys, "_x"), ["_x"], "_place", groups)
        on = [F.col(f"`{g}`").eqNullSafe(F.col(f"_t{i}")) for i, g in enumerate(groups)]
        wanted = totals.select(*[x.alias(f"_t{i}") for i, x in enumerate(keys)], "_m", "_first", low.alias("_low"), (at - low).alias("_part"), bad.alias("_bad"))
        met = placed.join(wanted, on).filter(F.col("_place").between(F.col("_low"), F.col("_low") + 1)) if groups else placed.crossJoin(F.broadcast(wanted)).filter(F.col("_place").between(F.col("_low"), F.col("_low") + 1))  # one row
        two = met.groupBy(*keys).agg(F.min("_x").alias("_a"), F.max("_x").alias("_c"))
        joined = wanted.join(two.select(*[x.alias(f"_u{i}") for i, x in enumerate(keys)], "_a", "_c"), [F.col(f"_t{i}").eqNullSafe(F.col(f"_u{i}")) for i in range(len(groups))], "left") if groups else wanted.join(two)
        value = F.when(~F.col("_bad"), F.col("_a") + F.col("_part") * (F.col("_c") - F.col("_a")))
        return joined.select(*[F.col(f"_t{i}").alias(g) for i, g in enumerate(groups)], value.alias("value"), F.coalesce("_first", F.when(F.col("_bad"), "#NUM!")).alias("error"))

    # ---- adding columns

    def add(self, letter: str, name: str, formula: str, base: int = 1) -> "Sheet":
        """The sheet with one more column; ``name_error`` beside it where errors can arise.

        Calls that need other rows by key or by place (conditional aggregates, lookups, ranks, aggregates within groups, running
        totals) become hidden columns first, the innermost before those around them.
        """
        tree = parse(formula)
        sheet, hidden = replace(self, base=base, found={}), []
        for node in reversed(list(walk(tree))):
            if isinstance(node, Call) and node not in sheet.found:
                sheet, t, columns = sheet._joined(node, f"_k{len(sheet.found)}_{name}")
                hidden += columns
                if t is not None:
                    sheet = replace(sheet, found={**sheet.found, node: t})
        back, ahead = sheet._reach(tree)
        if (back or ahead) and not self.within:
            sheet = sheet._blocked(back, ahead)
        with letting() as lets:
            t = sheet._tree(tree)
        value = F.lit(None).cast("double") if t.kind == "err" else t.value.cast("double") if t.kind == "num" else t.value
        errors = dict(self.errors)
        made = {name: value}
        if t.error is not None:
            # the error is computed beside the value, from the columns that were there before
            made[f"{name}_error"] = t.error
            errors[name] = f"{name}_error"
        df = sheet.df
        for named, column in lets:
            df = df.withColumn(named, column)
        df = df.withColumns(made).drop(*[named for named, _ in lets])
        if sheet.blocks:
            df = df.filter(F.col("_block") == F.floor(F.col("_n") / sheet.blocks[0])).drop("_block", "_n")
        return replace(self, df=df.drop(*hidden), columns={**self.columns, letter: name}, errors=errors, found={}, blocks=())

    def _reach(self, tree) -> tuple[int, int]:
        """How many rows before and after its own a formula looks at."""
        back = ahead = 0
        for n in self._outside(tree):
            if isinstance(n, Ref) and n.sheet is None and n.shape in ("cell", "range") and not n.fixed[0] and not n.fixed[2]:
                back, ahead = max(back, self.base - n.top), max(ahead, n.bottom - self.base)
        return back, ahead

    def _outside(self, node):
        """The nodes of a tree outside of the calls that are columns already."""
        if node in self.found if isinstance(node, Call) else False:
            return
        yield node
        for x in _below(node):
            yield from self._outside(x)

    def _blocked(self, back: int, ahead: int) -> "Sheet":
        """Rows numbered and dealt to blocks, with those around a block that its rows look at: no window runs in one task."""
        self._ordered()
        rows = max(WINDOW_ROWS, back, ahead)
        df = numbered(self.df, self.order)
        first, last = F.greatest(F.lit(0), F.floor((F.col("_n") - ahead) / rows)), F.floor((F.col("_n") + back) / rows)
        return replace(self, df=df.withColumn("_block", F.explode(F.sequence(first, last))), blocks=(rows,))

    def _joined(self, node: Call, column: str):
        """(sheet with hidden columns, what the call is with them, their names); the sheet as it is where the call needs none."""
        name, args = node.name, node.args
        f = lookup(name)
        if f is None or f.refused or len(args) < f.least or f.most >= 0 and len(args) > f.most:
            return self, None, []
        if name in _CONDITIONAL:
            return self._keyed(node, column)
        if name in _LOOKUPS and any(isinstance(a, Ref) and a.shape == "cols" for a in args):
            return self._looked(node, column)
        if name in ("RANK", "RANK.EQ") and _is_column(args[1]):
            return self._placed(node, column)
        if name in _AGGREGATES and len(args) == 1 and isinstance(args[0], Ref) and args[0].shape == "range" and args[0].fixed[0] and not args[0].fixed[2] and not self.within:
            return self._running(node, column)
        if name in _SUMMARIES and self.within and any(isinstance(n, Ref) and n.shape == "cols" and n.sheet is None for a in args for n in walk(a)):
            source, plan, kind, open_error = self._summary(name, args)
            groups = source.within
            rows = source._made(plan).select(*[F.col(f"`{g}`").alias(f"{column}_g{i}") for i, g in enumerate(groups)], F.col("value").alias(column), F.col("error").alias(f"{column}_e"))
            df = self.df.join(rows, [F.col(f"`{g}`").eqNullSafe(F.col(f"{column}_g{i}")) for i, g in enumerate(groups)], "left").drop(*[f"{column}_g{i}" for i in range(len(groups))])
            t = guarded(F.col(f"`{column}`"), kind, F.col(f"`{column}_e`") if open_error else None)
            return replace(self, df=df), self._opened(name, args, t), [column, f"{column}_e"]
        return self, None, []

    def _running(self, node: Call, column: str):
        """A running range from a fixed row: sums of the blocks before, and a window inside the block."""
        name, ref = node.name, node.args[0]
        if name not in ("SUM", "COUNT", "AVERAGE", "MIN", "MAX", "SUMSQ", "PRODUCT") or ref.left != ref.right or ref.sheet or ref.bottom != self.base:
            raise Refusal("REF_SHAPE", f"{unparse(node)} has no column form without groups", unparse(node))
        t = self._column(self._named(ref.left))
        self._ordered()
        x = t.value if t.kind == "num" else F.lit(None).cast("double")
        fold = {"MIN": F.min, "MAX": F.max, "PRODUCT": F.product}.get(name, F.sum)
        df = numbered(self.df, self.order).withColumn("_block", F.floor(F.col("_n") / WINDOW_ROWS))
        df = df.withColumns({"_rx": x * x if name == "SUMSQ" else x, "_re": F.lit(None).cast("string") if t.error is None else t.error})
        sums = df.groupBy(F.col("_block").alias("_bk")).agg(fold("_rx").alias("_s"), F.count("_rx").alias("_c"), F.min_by("_re", F.when(F.col("_re").isNotNull(), F.col("_n"))).alias("_e"))
        earlier = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each WINDOW_ROWS rows
        sums = sums.select("_bk", fold("_s").over(earlier).alias("_ps"), F.sum("_c").over(earlier).alias("_pc"), F.first("_e", ignorenulls=True).over(earlier).alias("_pe"))
        inside = Window.partitionBy("_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
        df = df.join(sums, F.col("_block") == F.col("_bk"))
        own, before = fold("_rx").over(inside), F.col("_ps")
        both = {"MIN": F.least(own, before), "MAX": F.greatest(own, before), "PRODUCT": F.coalesce(own, F.lit(1.0)) * F.coalesce(before, F.lit(1.0))}.get(name, F.coalesce(own, F.lit(0.0)) + F.coalesce(before, F.lit(0.0)))
        count = F.count("_rx").over(inside) + F.coalesce("_pc", F.lit(0))
        value = {"COUNT": count.cast("double"), "AVERAGE": F.try_divide(both, count)}.get(name, F.when(count > 0, both).otherwise(0.0))
        error = F.coalesce("_pe", F.first("_re", ignorenulls=True).over(inside))
        df = df.withColumns({column: value, f"{column}_e": error}).drop("_block", "_bk", "_n", "_rx", "_re", "_ps", "_pc", "_pe")
        t = self._closed(name, F.col(f"`{column}`"), None if t.error is None else F.col(f"`{column}_e`"))
        return replace(self, df=df), t, [column, f"{column}_e"]

    def _placed(self, node: Call, column: str):
        """RANK of this row's cell of the same column: its place among the values, ties sharing the best."""
        x, area = node.args[0], node.args[1]
        up = _constant(node.args[2]) if len(node.args) > 2 else 0
        if not (isinstance(x, Ref) and x.shape == "cell" and x.top == self.base and x.left == area.left and x.sheet is None and area.sheet is None) or up is None:
            raise Refusal("ARG_UNSUPPORTED", "RANK has a column form for this row's cell within its own column", node.name)
        t = self._column(self._named(area.left))
        if t.kind != "num":
            raise Refusal("ARG_UNSUPPORTED", "RANK of what is no number has no column form", node.name)
        df = numbered(self.df.withColumn("_rx", t.value if up else -t.value), ["_rx"], "_place", self.within)
        groups = [f"`{g}`" for g in self.within]
        blanks = df.filter("_rx is null").groupBy(*groups).agg(F.count(F.lit(1)).alias("_nulls"))  # they come first
        first = df.groupBy(*groups, "_rx").agg(F.min("_place").alias("_f"))
        first = first.select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(groups)], F.col("_rx").alias("_hx"), "_f")
        df = df.join(first, [F.col(g).eqNullSafe(F.col(f"_h{i}")) for i, g in enumerate(groups)] + [F.col("_rx").eqNullSafe(F.col("_hx"))])
        if groups:
            blanks = blanks.select(*[F.col(g).alias(f"_l{i}") for i, g in enumerate(groups)], "_nulls")
            df = df.join(blanks, [F.col(g).eqNullSafe(F.col(f"_l{i}")) for i, g in enumerate(groups)], "left")
        else:
            df = df.withColumn("_nulls", blanks.select("_nulls").scalar())
        df = df.withColumn(column, (F.col("_f") - F.coalesce("_nulls", F.lit(0)) + 1).cast("double"))
        df = df.drop("_rx", "_place", "_hx", "_f", "_nulls", *[f"_h{i}" for i in range(len(groups))], *[f"_l{i}" for i in range(len(groups))])
        error = None
        if t.error is not None:
            others = self.df.groupBy(*groups).agg(_first_error(t.error, self.order).alias("e"))
            if groups:
                raise Refusal("ARG_UNSUPPORTED", "RANK within groups over a column that can hold errors has no column form", node.name)
            error = F.coalesce(t.error, others.select("e").scalar())
        # a blank counts as 0, which may not be among the values
        blank = t.value.isNull() if t.error is None else t.value.isNull() & t.error.isNull()
        seen = self.df.agg(F.count_if(blank).alias("blanks"), F.count_if(t.value == 0).alias("zeros")).first()
        if seen["blanks"] and (seen["zeros"] or groups):
            raise Refusal("ARG_UNSUPPORTED", "RANK of blank cells among zeros or within groups has no column form", node.name)
        missing = F.when(t.value.isNull(), "#N/A") if seen["blanks"] else None
        return replace(self, df=df), guarded(F.col(f"`{column}`"), "num", error, missing), [column]

    # ---- lookups

    def _looked(self, node: Call, column: str):
        """A lookup in whole columns: the first (or last) row of each key, or the span that holds the key, joined from the left."""
        name, args = node.name, list(node.args)
        constant = lambda k, default: default if len(args) <= k else 0 if isinstance(args[k], Missing) else _constant(args[k])
        fallback, result, how, wild, last = None, None, 0, True, False
        if name == "VLOOKUP":
            table, k = args[1], _whole(_constant(args[2]), name)
            if not isinstance(table, Ref) or table.shape != "cols":
                raise Refusal("REF_SHAPE", "the table must be whole columns to have a column form", name)
            if k < 1 or table.left + k - 1 > table.right:
                return self, _fault("#VALUE!" if k < 1 else "#REF!"), []
            key, area, result, how = args[0], replace(table, right=table.left), replace(table, left=table.left + k - 1, right=table.left + k - 1), -1 if constant(3, True) else 0
        elif name == "XLOOKUP":
            key, area, result, how, wild, last = args[0], args[1], args[2], -(-1 if constant(4, 0) == 1 else 1 if constant(4, 0) == -1 else 0), constant(4, 0) == 2, constant(5, 1) == -1
            fallback = args[3] if len(args) > 3 and not isinstance(args[3], Missing) else None
        elif name == "LOOKUP":
            key, area, result, how = args[0], args[1], args[2] if len(args) > 2 else args[1], -1
        elif name in ("MATCH", "XMATCH"):
            kind = constant(2, 1 if name == "MATCH" else 0)
            if kind is None:
                raise Refusal("ARG_UNSUPPORTED", f"{name}'s kind of match must be a constant", name)
            kind = float(kind)
            key, area = args[0], args[1]
            how = (0 if kind == 0 else -1 if kind > 0 else 1) if name == "MATCH" else (0 if kind in (0, 2) else int(kind))
            wild, last = name == "MATCH" or kind == 2, name == "XMATCH" and constant(3, 1) == -1
        else:
            inner = args[1]
            if len(args) == 3 and _constant(args[2]) != 1 or not _is_column(args[0]):
                raise Refusal("REF_SHAPE", "INDEX has a column form over one whole column", name)
            return self._indexed(node, column, inner)
        if not _is_column(area) or result is not None and (not _is_column(result) or result.sheet != area.sheet):
            raise Refusal("REF_SHAPE", "lookups must be in single whole columns of one sheet to have a column form", name)
        source = replace(self._source(area), found={}, blocks=())
        source._ordered()
        held, mine = source._column(source._named(area.left)), self._tree(key)
        if held.kind != mine.kind:
            raise Refusal("ARG_UNSUPPORTED", "a key of another type than its column has no column form", name)
        got = None if result is None else source._column(source._named(result.left))
        place = F.struct(*[F.col(f"`{o}`") for o in source.order])
        rows = source.df
        if result is None:
            rows, place = numbered(rows, source.order, "_at"), F.col("_at")
        value = (F.col("_at") + 1).cast("double") if got is None else got.value
        rows = rows.select(held.value.alias("_tk"), F.lit(None).cast("string").alias("_te") if held.error is None else held.error.alias("_te"), place.alias("_to"), value.alias("_tv"), F.lit(None).cast("string").alias("_tx") if got is None or got.error is None else got.error.alias("_tx")).filter("_te is null")
        e = lambda c: F.col(f"`{column}_{c}`")
        if how:
            df, where = self._near(rows, mine, how, name, column, place)
        else:
            df, where = self._exact(rows, mine, wild, last, column, name)
        kind = "num" if got is None else got.kind
        t = guarded(F.col(f"`{column}`"), kind, mine, F.when(~where, "#N/A"), None if got is None or got.error is None else e("x"))
        hidden = [column, f"{column}_x", f"{column}_f"]
        out = replace(self, df=df)
        if fallback is not None:
            other = out._tree(fallback)
            value = F.when(where, t.value).otherwise(other.value)
            errors = error_of(mine, F.when(~where, F.lit(None).cast("string") if other.error is None else other.error).otherwise(F.lit(None).cast("string") if got is None or got.error is None else e("x")))
            if other.kind not in (kind, "err"):
                raise Refusal("ARG_UNSUPPORTED", "a fallback of another type than the result has no column form", name)
            t = guarded(value, kind, errors)
        return out, t, hidden

    def _exact(self, rows: DataFrame, mine: Typed, wild: bool, last: bool, column: str, name: str):
        """(rows with the hit, whether there is one); blank cells equal 0, an empty text and FALSE."""
        fold = (lambda c: F.upper(F.coalesce(c, F.lit("")))) if mine.kind == "text" else lambda c: F.coalesce(c, F.lit(0.0 if mine.kind == "num" else False))
        pick = F.max_by if last else F.min_by
        hits = rows.withColumn("_hk", fold(F.col("_tk"))).groupBy("_hk").agg(pick(F.struct("_tv", "_tx"), F.col("_to")).alias("_hit"))
        df = self.df.withColumn("_mk", fold(mine.value))
        df = df.join(hits, F.col("_mk") == F.col("_hk"), "left")
        hit, found = F.col("_hit"), F.col("_hk").isNotNull()
        if wild and mine.kind == "text":
            odd = F.coalesce(mine.value.rlike(r"[*?~]"), F.lit(False))
            patterns = self.df.filter(odd).select(F.upper(mine.value).alias("_pk")).distinct()
            if (n := patterns.limit(MOST_ODD + 1).count()) > MOST_ODD:
                raise Refusal("LIMIT", f"more than {MOST_ODD} different patterns are looked up", name)
            if n:
                texts = rows.filter("_tk is not null").groupBy(F.upper("_tk").alias("_tu")).agg(pick(F.struct("_tv", "_tx"), F.col("_to")).alias("_h"), (F.max if last else F.min)("_to").alias("_o"))
                met = texts.join(F.broadcast(patterns), F.regexp("_tu", wildcard_pattern(F.col("_pk"))))  # MOST_ODD patterns at most
                met = met.groupBy("_pk").agg(pick("_h", F.col("_o")).alias("_ph"))
                df = df.join(F.broadcast(met), F.col("_mk") == F.col("_pk"), "left")
                hit, found = F.when(odd, F.col("_ph")).otherwise(hit), F.when(odd, F.col("_pk").isNotNull()).otherwise(found)
        df = df.withColumns({column: hit["_tv"], f"{column}_x": hit["_tx"], f"{column}_f": found})
        return df.drop("_mk", "_hk", "_hit", "_pk", "_ph"), F.col(f"`{column}_f`")

    def _near(self, rows: DataFrame, mine: Typed, how: int, name: str, column: str, place: Column):
        """``how`` -1: the greatest key at or below, 1: the least at or above. Searches that go by halving refuse unsorted keys."""
        if mine.kind != "num":
            raise Refusal("ARG_UNSUPPORTED", "approximate matches of what is no number have no column form", name)
        sorted_only = name in ("VLOOKUP", "LOOKUP", "MATCH")
        rows = rows.filter("_tk is not null")
        if rows.schema["_to"].dataType.typeName() == "struct":
            rows = rows.withColumn("_to", F.col(f"_to.`{rows.schema['_to'].dataType.names[0]}`"))
        if sorted_only and unsorted(rows.withColumn("_tk", F.col("_tk") * -how), "_tk", "_to").first()["inversions"]:
            raise Refusal("ARG_UNSUPPORTED", f"{name} by approximate match needs sorted data", name)
        # of equal keys a search by halving ends at the last, the others at the first
        sign = (1 if how < 0 else -1) * (1 if sorted_only else -1)
        table = rows.select(F.col("_tk"), (order_key(rows, "_to") * sign).alias("_to"), F.col("_tv").alias(column), F.col("_tx").alias(f"{column}_x"), F.lit(True).alias(f"{column}_f"))
        df = self.df.withColumn("_mk", number(mine).value)
        df = approximate_lookup(df, F.col("_mk"), table, "_tk", ["_to", column, f"{column}_x", f"{column}_f"], how > 0)
        return df.drop("_mk", "_to"), F.coalesce(F.col(f"`{column}_f`"), F.lit(False))

    def _indexed(self, node: Call, column: str, inner):
        """INDEX of a whole column at a place: the row of that number, joined; place 0 or none is refused, one beyond the rows is blank."""
        source = replace(self._source(node.args[0]), found={}, blocks=())
        got = source._column(source._named(node.args[0].left))
        rows = numbered(source.df, source._ordered(), "_at").select((F.col("_at") + 1).alias("_ip"), got.value.alias(column), F.lit(None).cast("string").alias(f"{column}_x") if got.error is None else got.error.alias(f"{column}_x"))
        at = number(self._tree(inner))
        p = F.signum(at.value) * F.floor(F.abs(at.value))
        df = self.df.withColumn("_mp", p).join(rows, F.col("_mp") == F.col("_ip"), "left").drop("_mp", "_ip")
        t = guarded(F.col(f"`{column}`"), got.kind, at, F.when(p < 1, "#VALUE!").when(p > 1_048_576, "#REF!"), None if got.error is None else F.col(f"`{column}_x`"))
        return replace(self, df=df), t, [column, f"{column}_x"]

    # ---- conditional aggregates

    def _keyed(self, call: Call, column: str):
        """Conditional aggregates: constant criteria filter, criteria from this row become join keys where they are plain values;
        others (operators, wildcards) are met with the range's different values, MOST_ODD of them at most."""
        args = list(call.args)
        if call.name in ("SUMIF", "AVERAGEIF"):
            target, pairs = args[2] if len(args) > 2 else args[0], [(args[0], args[1])]
        elif call.name in ("COUNTIF", "COUNTIFS"):
            target, pairs = None, list(zip(args[::2], args[1::2]))
        else:
            target, pairs = args[0], list(zip(args[1::2], args[2::2]))
        areas = [a for a, _ in pairs] + ([target] if target is not None else [])
        if any(not _is_column(a) for a in areas) or len({a.sheet for a in areas}) != 1:
            raise Refusal("REF_SHAPE", "criteria ranges must be whole columns of one sheet to have a column form", call.name)
        source = replace(self._source(areas[0]), found={}, blocks=())
        if source.within:
            raise Refusal("REF_SHAPE", "conditional aggregates within groups have no column form: give the groups as criteria", call.name)
        aggregate = _CONDITIONAL[call.name]
        rows, own, mine = source.df, [], []
        for area, c in pairs:
            held = source._column(source._named(area.left))
            if (k := _constant(c)) is not None or isinstance(c, (Lit, Missing)):
                rows = rows.filter(matches(held, k))
                continue
            t = self._tree(c)
            if t.error is not None:
                raise Refusal("ARG_UNSUPPORTED", "criteria that may be errors have no column form", call.name)
            own.append(held)
            mine.append(t)
        x = Typed(F.lit(1.0), "num") if target is None else source._column(source._named(target.left))
        state = [F.lit(1.0).alias("_x") if target is None else (x.value if x.kind == "num" else F.lit(None).cast("double")).alias("_x"), F.lit(None).cast("string").alias("_e") if x.error is None else x.error.alias("_e"), *[F.col(f"`{o}`").alias(f"_o{i}") for i, o in enumerate(source.order)]]
        place = F.struct(*[F.col(f"_o{i}") for i in range(len(source.order))]) if source.order else F.lit(0)
        found = lambda n, total, low, high, e, at: [n.alias("_n"), total.alias("_s"), low.alias("_lo"), high.alias("_hi"), e.alias("_e"), at.alias("_at")]
        bad = F.when(F.col("_e").isNotNull(), place)
        first = found(F.count("_x"), F.sum("_x"), F.min("_x"), F.max("_x"), F.min_by("_e", bad) if source.order else F.min("_e"), F.min(bad))
        again = found(F.sum("_n"), F.sum("_s"), F.min("_lo"), F.max("_hi"), F.min_by("_e", "_at") if source.order else F.min("_e"), F.min("_at"))
        n = F.coalesce("_n", F.lit(0))
        value = {"COUNT": n.cast("double"), "SUM": F.coalesce("_s", F.lit(0.0)), "AVERAGE": F.try_divide(F.col("_s"), n), "MAX": F.coalesce("_hi", F.lit(0.0)), "MIN": F.coalesce("_lo", F.lit(0.0))}[aggregate]
        c, e = F.col(f"`{column}`"), F.col(f"`{column}_e`")
        closed = Typed(c, "num") if aggregate == "COUNT" else finite(c, e if x.error is not None else None, F.when(c.isNull(), "#DIV/0!") if aggregate == "AVERAGE" else None)
        if not own:
            s = rows.select(*state).agg(*first).select(F.struct(value.cast("double").alias("value"), F.col("_e").alias("error"))).scalar()
            return replace(self, df=self.df.withColumns({column: s["value"], f"{column}_e": s["error"]})), closed, [column, f"{column}_e"]
        held_e = [F.lit(False) if h.error is None else h.error.isNotNull() for h in own]
        slim = rows.select(*[h.value.alias(f"_v{i}") for i, h in enumerate(own)], *[b.alias(f"_b{i}") for i, b in enumerate(held_e)], *state)
        raw = [*[f"_v{i}" for i in range(len(own))], *[f"_b{i}" for i in range(len(own))]]
        values = slim.groupBy(*raw).agg(*first)  # a row for each different tuple of values
        by, plain, odd = values.filter(~F.greatest(*[F.col(f"_b{i}") for i in range(len(own))], F.lit(False))), F.lit(True), F.lit(False)
        left = self.df
        for i, (h, t) in enumerate(zip(own, mine)):
            keys, key, fits, strange = _key_form(Typed(F.col(f"_v{i}"), h.kind), t)
            by = by.withColumn(f"_g{i}", F.explode(keys))
            left = left.withColumn(f"_m{i}", key)
            plain, odd = plain & fits, odd | strange
        by = by.groupBy(*[f"_g{i}" for i in range(len(own))]).agg(*again)
        left = left.withColumns({"_plain": F.coalesce(plain, F.lit(False)), "_odd": F.coalesce(odd, F.lit(False)), **{f"_c{i}": t.value for i, t in enumerate(mine)}})
        on = [F.col(f"_m{i}") == F.col(f"_g{i}") for i in range(len(own))] + [F.col("_plain")]
        states = ["_n", "_s", "_lo", "_hi", "_e", "_at"]
        df = left.join(by, on, "left").drop(*[f"_g{i}" for i in range(len(own))])
        if any(not (h.kind == t.kind and h.kind != "text") for h, t in zip(own, mine)):
            strange = left.filter("_odd").select(*[f"_c{i}" for i in range(len(own))]).distinct()
            if (count := strange.limit(MOST_ODD + 1).count()) > MOST_ODD:
                raise Refusal("LIMIT", f"more than {MOST_ODD} different criteria are more than plain values", call.name)
            if count:
                strange = strange.select(*[F.col(f"_c{i}").alias(f"_d{i}") for i in range(len(own))])
                test = F.lit(True)
                for i, (h, t) in enumerate(zip(own, mine)):
                    test = test & row_matches(Typed(F.col(f"_v{i}"), h.kind, F.when(F.col(f"_b{i}"), "#N/A")), Typed(F.col(f"_d{i}"), t.kind))
                met = values.join(F.broadcast(strange), test).groupBy(*[f"_d{i}" for i in range(len(own))]).agg(*again)
                met = met.select(*[f"_d{i}" for i in range(len(own))], *[F.col(x).alias(f"{x}2") for x in states])
                df = df.join(F.broadcast(met), [F.col(f"_c{i}").eqNullSafe(F.col(f"_d{i}")) for i in range(len(own))] + [F.col("_odd")], "left")
                df = df.withColumns({x: F.when(F.col("_odd"), F.col(f"{x}2")).otherwise(F.col(x)) for x in states}).drop(*[f"{x}2" for x in states], *[f"_d{i}" for i in range(len(own))])
        df = df.withColumns({column: value.cast("double"), f"{column}_e": F.col("_e")}).drop("_plain", "_odd", *states, *[f"_m{i}" for i in range(len(own))], *[f"_c{i}" for i in range(len(own))])
        return replace(self, df=df), closed, [column, f"{column}_e"]


def _below(node):
    match node:
        case Call(_, args):
            return args
        case Unary(_, x) | Percent(x):
            return (x,)
        case Binary(_, l, r):
            return (l, r)
    return ()


def _key_form(held: Typed, mine: Typed) -> tuple[Column, Column, Column, Column]:
    """For a criterion that is a plain value: (keys under which a held value is met, the criterion's key, whether it is plain, whether
    it must be met otherwise). A criterion that is neither meets nothing. NaN stands for a blank."""
    v, c = held.value, mine.value
    number_keys = lambda x, blanks: F.when(x.isNull(), F.array(*[F.lit(b) for b in blanks])).otherwise(F.array(x + 0.0))
    if held.kind == mine.kind and held.kind in ("num", "bool"):
        return number_keys(v.cast("double"), (0.0, math.nan)), F.coalesce(c.cast("double") + 0.0, F.lit(math.nan)), F.lit(True), F.lit(False)
    if mine.kind != "text":
        # another type: only blank cells equal 0 and FALSE
        return F.array(F.lit(math.nan)), F.lit(math.nan), F.lit(False), F.coalesce(c.cast("double") == 0, F.lit(True))
    simple = ~F.coalesce(c.rlike(r"^[<>=]|[*?~]"), F.lit(False))
    n = parsed_number(c)
    blank = F.coalesce(c == "", F.lit(True))
    if held.kind == "num":
        return number_keys(v, (math.nan,)), F.when(blank, math.nan).otherwise(n + 0.0), blank | (simple & n.isNotNull()), ~blank & ~simple
    if held.kind == "text":
        logical = F.coalesce(F.upper(c).isin("TRUE", "FALSE"), F.lit(False))
        return F.array(F.upper(F.coalesce(v, F.lit("")))), F.upper(F.coalesce(c, F.lit(""))), blank | (simple & n.isNull() & ~logical), ~blank & ~simple
    return F.array(F.lit(math.nan)), F.lit(math.nan), F.lit(False), F.lit(True)


def wildcard_pattern(c: Column) -> Column:
    """A column of wildcard patterns as regular expressions: ``*`` any run, ``?`` any character, ``~`` takes the next literally."""
    kept = F.replace(F.replace(F.replace(c, F.lit("~~"), F.lit("\x01")), F.lit("~*"), F.lit("\x02")), F.lit("~?"), F.lit("\x03"))
    plain = F.regexp_replace(kept, r"([\\.\[\]{}()+\-^$|/])", r"\\$1")
    wide = F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    exact = F.replace(F.replace(F.replace(wide, F.lit("\x01"), F.lit("~")), F.lit("\x02"), F.lit(r"\*")), F.lit("\x03"), F.lit(r"\?"))
    return F.concat(F.lit(r"(?is)\A"), exact, F.lit(r"\z"))


def pattern(text: str) -> str:
    """A wildcard criterion as a regular expression."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "~" and i + 1 < len(text) and text[i + 1] in "*?~":
            i += 1
            out.append("\\" + text[i])
        else:
            out.append({"*": ".*", "?": "."}.get(c) or ("\\" + c if c in r"\.[]{}()+-^$|/" else c))
        i += 1
    return "(?is)^" + "".join(out) + "$"


def matches(held: Typed, criterion) -> Column:
    """A constant criterion as a predicate over a column: what COUNTIF counts. An error value meets none but ``<>``."""
    if held.error is not None:
        other = isinstance(criterion, str) and criterion.startswith("<>")
        return F.when(held.error.isNotNull(), other).otherwise(matches(Typed(held.value, held.kind), criterion))
    v, blank = held.value, held.value.isNull() if held.kind != "text" else held.value.isNull() | (held.value == "")
    if criterion is None or criterion == "" and isinstance(criterion, str):
        return blank
    if not isinstance(criterion, str):
        return F.coalesce(compared("=", held, _lit(criterion)).value, F.lit(False))
    op, x = split_criterion(criterion)
    if x == "" and isinstance(x, str) and op in ("", "=", "<>"):
        return ~blank if op == "<>" else blank
    kind = "bool" if isinstance(x, bool) else "num" if isinstance(x, float) else "text"
    if op in ("", "=", "<>"):
        if kind == "text" and has_wildcard(x):
            hit = text(held).value.rlike(pattern(x)) & v.isNotNull() if held.kind != "bool" else F.lit(False)
        else:
            hit = (F.upper(v) == x.upper() if kind == "text" else v == F.lit(x)) if kind == held.kind else F.lit(False)
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if op == "<>" else hit
    if kind != held.kind:
        return F.lit(False)
    return F.coalesce(compared(op, held, _lit(x)).value & v.isNotNull(), F.lit(False))


def row_matches(held: Typed, criterion: Typed) -> Column:
    """A criterion of each row as a predicate over a range's cells: operators, numbers, wildcards and blanks as in ``matches``."""
    v, c = held.value, criterion.value
    failed = F.lit(False) if held.error is None else held.error.isNotNull()
    empty = v.isNull() if held.kind != "text" else v.isNull() | (v == "")
    blank = empty & ~failed
    if criterion.kind != "text":
        zero = F.coalesce(c.cast("double") == 0, F.lit(False)) & v.isNull()
        same = F.coalesce(v == c, F.lit(False)) if held.kind == criterion.kind else F.lit(False)
        return ~failed & F.when(c.isNull(), blank).otherwise(zero | same)
    op = F.regexp_extract(c, r"(?s)^(<=|>=|<>|=|<|>)?", 1)
    x = F.substring(c, F.length(op) + 1, F.length(c))
    n, logical = parsed_number(x), F.upper(x).isin("TRUE", "FALSE")
    wild = n.isNull() & ~logical & x.rlike(r"[*?~]")
    if held.kind == "num":
        own, same = n.isNotNull(), v == n
        order = lambda f: f(v, n)
    elif held.kind == "bool":
        own, same = logical, v == (F.upper(x) == "TRUE")
        order = lambda f: f(v.cast("int"), (F.upper(x) == "TRUE").cast("int"))
    else:
        own, same = n.isNull() & ~logical, F.upper(v) == F.upper(x)
        order = lambda f: f(F.upper(v), F.upper(x))
    like = F.lit(False) if held.kind == "bool" else F.regexp(text(Typed(v, held.kind)).value, wildcard_pattern(x)) & v.isNotNull()
    hit = ~failed & F.coalesce(F.when(wild, like).otherwise(own & same), F.lit(False))
    ordered = F.when(op == ">=", order(lambda a, b: a >= b)).when(op == "<=", order(lambda a, b: a <= b)).when(op == ">", order(lambda a, b: a > b)).otherwise(order(lambda a, b: a < b))
    none = F.coalesce(c == "", F.lit(True)) | ((x == "") & op.isin("", "="))
    return F.when(none, blank).when((x == "") & (op == "<>"), ~blank).when(op.isin("", "="), hit).when(op == "<>", ~hit).otherwise(~failed & F.coalesce(own & ordered, F.lit(False)))


def row_criterion(held: Typed, criterion: Column) -> Column:
    """A criterion's text of each row, such as ">=5": operator and operand are split in the plan."""
    return row_matches(held, Typed(criterion, "text"))
