"""Table mode's scalar functions: formulas as Spark columns.

A compiled expression has a value column, a type class known while compiling, and an error column (null, or an error kind)
when one can arise. Blank is null. Everything stays in built-in functions, inside code generation, with no Python.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..formula.values import Refusal, number_text


class Typed:
    """``value`` of a constant is made when it is asked for: a literal column needs a session, this module does not."""

    def __init__(self, value: Column | None, kind: str, error: Column | None = None, constant: object = None):
        self._value, self.kind, self.error, self.constant = value, kind, error, constant

    @property
    def value(self) -> Column:
        if self._value is not None:
            return self._value
        return F.lit(float(self.constant) if self.kind == "num" else self.constant)


#: Columns to be made first while a formula becomes a column of a sheet; none are collected elsewhere.
_lets: list[tuple[str, Column]] | None = None


@contextmanager
def letting():
    """Collects the columns that ``let`` names meanwhile."""
    global _lets
    before, _lets = _lets, []
    try:
        yield _lets
    finally:
        _lets = before


def let(value: Column) -> Column:
    """A value that is used more than once: a column of its own where columns are collected, so it is computed once."""
    if _lets is None:
        return value
    _lets.append((f"_let{len(_lets)}", value))
    return F.col(_lets[-1][0])


def _lit(v) -> Typed:
    return Typed(None, "bool" if isinstance(v, bool) else "text" if isinstance(v, str) else "num", None, v)


def error_of(*parts: Typed | Column | None) -> Column | None:
    """The first error, left to right."""
    found = [p.error if isinstance(p, Typed) else p for p in parts]
    found = [e for e in found if e is not None]
    return F.coalesce(*found) if len(found) > 1 else found[0] if found else None


def guarded(value: Column, kind: str, *errors) -> Typed:
    """A value that is null where there is an error."""
    e = error_of(*errors)
    return Typed(value if e is None else F.when(e.isNull(), value), kind, e)


def when_error(condition: Column, kind: str) -> Column:
    return F.when(condition, F.lit(kind))


def general_text(x: Column) -> Column:
    """Numbers as General text: 15 significant digits, scientific from exponent 16 on and from -15 down."""
    shown = F.format_string("%.14e", x)
    size = F.abs(x)
    plain = lambda d: F.regexp_replace(F.regexp_replace(shown.try_cast(f"decimal(38,{d})").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    science = F.concat(F.regexp_replace(F.regexp_replace(F.substring_index(shown, "e", 1), r"0+$", ""), r"\.$", ""), F.lit("E"), F.when(size >= 1, "+").otherwise("-"), F.abs(F.substring_index(shown, "e", -1).try_cast("int")).cast("string"))
    return F.when(x == 0, "0").when((size >= 1e-4) & (size < 1e16), plain(18)).when((size >= 1e-14) & (size < 1e-4), plain(30)).otherwise(science)


def parsed_number(text: Column) -> Column:
    """The number that a text spells, or null: sign, $, thousands commas, exponent, trailing %."""
    bare = F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")
    ok = bare.rlike(r"^[+-]?\$?(\d{1,3}(,\d{3})+|\d+|(?=\.\d))(\.\d*)?([eE][+-]?\d+)?%?$")
    number = F.regexp_replace(bare, r"[$,%]", "").try_cast("double")
    return F.when(ok, F.when(bare.endswith("%"), number / 100).otherwise(number))


def number(t: Typed) -> Typed:
    """Coercion in arithmetic: text that spells a number, booleans 1 and 0, blank 0; other text is #VALUE!."""
    if t.kind == "num":
        return Typed(F.coalesce(t.value, F.lit(0.0)), "num", t.error, t.constant) if t.constant is None else t
    if t.kind == "bool":
        return Typed(F.coalesce(t.value.cast("double"), F.lit(0.0)), "num", t.error)
    if t.kind == "text":
        n = parsed_number(t.value)
        return guarded(F.coalesce(n, F.lit(0.0)), "num", t, when_error(t.value.isNotNull() & n.isNull(), "#VALUE!"))
    return Typed(F.lit(None).cast("double"), "num", t.error)


def text(t: Typed) -> Typed:
    if t.kind == "text":
        return Typed(F.coalesce(t.value, F.lit("")), "text", t.error)
    if t.kind == "bool":
        return Typed(F.coalesce(F.upper(t.value.cast("string")), F.lit("")), "text", t.error)
    if t.kind == "num":
        return Typed(F.lit(number_text(float(t.constant))) if t.constant is not None else F.coalesce(general_text(t.value), F.lit("")), "text", t.error)
    return Typed(F.lit(None).cast("string"), "text", t.error)


def boolean(t: Typed) -> Typed:
    if t.kind == "bool":
        return Typed(F.coalesce(t.value, F.lit(False)), "bool", t.error)
    if t.kind == "num":
        return Typed(F.coalesce(t.value != 0, F.lit(False)), "bool", t.error)
    if t.kind == "text":
        word = F.upper(F.trim(t.value))
        return guarded(F.coalesce(word == "TRUE", F.lit(False)), "bool", t, when_error(t.value.isNotNull() & ~word.isin("TRUE", "FALSE"), "#VALUE!"))
    return Typed(F.lit(None).cast("boolean"), "bool", t.error)


_RANK = {"num": 0, "text": 1, "bool": 2}
_ZERO = {"num": 0.0, "text": "", "bool": False}


def compared(op: str, a: Typed, b: Typed) -> Typed:
    """Comparison by type class: decided while compiling where the classes differ; blank takes the other side's class."""
    e = error_of(a, b)
    test: Callable = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if "err" in (a.kind, b.kind):
        return Typed(F.lit(None).cast("boolean"), "bool", e)
    if a.kind == b.kind:
        x, y = (F.coalesce(t.value, F.lit(_ZERO[t.kind])) for t in (a, b))
        if a.kind == "text":
            x, y = F.upper(x), F.upper(y)
        return guarded(test(x, y), "bool", e)
    known = test(_RANK[a.kind], _RANK[b.kind])
    x = F.when(a.value.isNull(), test(F.lit(_ZERO[b.kind]), F.coalesce(F.upper(b.value) if b.kind == "text" else b.value, F.lit(_ZERO[b.kind])))).when(b.value.isNull(), test(F.upper(a.value) if a.kind == "text" else a.value, F.lit(_ZERO[a.kind]))).otherwise(F.lit(known))
    return guarded(x, "bool", e)


def finite(value: Column, *errors) -> Typed:
    return guarded(value, "num", *errors, when_error(F.isnan(value) | (F.abs(value) == math.inf), "#NUM!"))


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    a, b = number(a), number(b)
    x, y = a.value, b.value
    if op == "/":
        return finite(F.try_divide(x, y), a, b, when_error(y == 0, "#DIV/0!"))
    if op == "^":
        return finite(F.when((x == 0) & (y < 0), math.nan).otherwise(F.pow(x, y)), a, b)
    return finite({"+": x + y, "-": x - y, "*": x * y}[op], a, b)


def rounded(x: Column, digits: int, how: str = "half") -> Column:
    """Rounds the 15-digit decimal that x shows, half away from zero, up (away) or down (towards zero)."""
    shown = F.format_string("%.14e", x).try_cast("decimal(38,15)")  # a null shows as text that is no number
    size = F.abs(shown)
    if how == "half":
        out = F.round(size, digits)
    else:
        out = (F.ceil if how == "up" else F.floor)(size, F.lit(digits))
    return F.coalesce(F.signum(x) * out.cast("double"), x)  # beyond 23 digits nothing is left to round


# ---- functions ---------------------------------------------------------------------------------------------------------

COMPILERS: dict[str, Callable] = {}


def compiles(names: str):
    def add(f):
        for name in names.split():
            COMPILERS[name] = f
        return f

    return add


def _digits(t: Typed) -> int:
    if t.constant is None:
        raise Refusal("ARG_UNSUPPORTED", "a column of digits is not compiled", "ROUND")
    return math.trunc(float(t.constant))


def _math(name: str, f, bad=None) -> None:
    def build(x):
        x = number(x)
        e = when_error(bad(x.value), "#NUM!") if bad else None
        return finite(F.when(e.isNull(), f(x.value)) if e is not None else f(x.value), x, e)

    COMPILERS[name] = build


for _n, _f, _bad in (
    ("ABS", F.abs, None), ("SIGN", F.signum, None), ("INT", lambda x: F.floor(x).cast("double"), None), ("EXP", F.exp, None), ("SQRT", F.sqrt, lambda x: x < 0), ("LN", F.log, lambda x: x <= 0), ("LOG10", F.log10, lambda x: x <= 0),
    ("SIN", F.sin, None), ("COS", F.cos, None), ("TAN", F.tan, None), ("SINH", F.sinh, None), ("COSH", F.cosh, None), ("TANH", F.tanh, None), ("ATAN", F.atan, None), ("ASIN", F.asin, lambda x: F.abs(x) > 1), ("ACOS", F.acos, lambda x: F.abs(x) > 1),
    ("DEGREES", F.degrees, None), ("RADIANS", F.radians, None), ("EVEN", lambda x: F.signum(x) * 2 * F.ceil(F.abs(x) / 2), None), ("ODD", lambda x: F.when(x == 0, 1.0).otherwise(F.signum(x) * (2 * F.ceil((F.abs(x) - 1) / 2) + 1)), None),
):
    _math(_n, _f, _bad)
for _n, _how in (("ROUND", "half"), ("ROUNDUP", "up"), ("ROUNDDOWN", "down"), ("TRUNC", "down")):
    COMPILERS[_n] = lambda x, d=_lit(0.0), how=_how: finite(rounded(number(x).value, _digits(d), how), number(x))
COMPILERS["PI"] = lambda: _lit(math.pi)
COMPILERS["POWER"] = lambda x, y: arithmetic("^", x, y)


@compiles("LOG")
def _log(x, base=_lit(10.0)):
    x, b = number(x), number(base)
    e = when_error((x.value <= 0) | (b.value <= 0) | (b.value == 1), "#NUM!")
    return finite(F.when(e.isNull(), F.log(x.value) / F.log(b.value)), x, b, e)


@compiles("MOD")
def _mod(x, d):
    x, d = number(x), number(d)
    return finite(x.value - d.value * F.floor(F.try_divide(x.value, d.value)), x, d, when_error(d.value == 0, "#DIV/0!"))


@compiles("QUOTIENT")
def _quotient(x, d):
    x, d = number(x), number(d)
    q = F.try_divide(x.value, d.value)
    return finite(F.signum(q) * F.floor(F.abs(q)), x, d, when_error(d.value == 0, "#DIV/0!"))


def _steps(x: Column, s: Column, up: bool) -> Column:
    q = F.format_string("%.14e", F.try_divide(x, s)).try_cast("decimal(38,15)")
    return (F.ceil(q) if up else F.floor(q)).cast("double") * s


@compiles("MROUND")
def _mround(x, m):
    x, m = number(x), number(m)
    return finite(F.when(m.value == 0, 0.0).otherwise(rounded(F.try_divide(x.value, m.value), 0) * m.value), x, m, when_error(x.value * m.value < 0, "#NUM!"))


@compiles("CEILING")
def _ceiling(x, s):
    x, s = number(x), number(s)
    return finite(F.when(s.value == 0, 0.0).otherwise(_steps(x.value, s.value, True)), x, s, when_error(x.value * s.value < 0, "#NUM!"))


@compiles("FLOOR")
def _floor(x, s):
    x, s = number(x), number(s)
    return finite(_steps(x.value, s.value, False), x, s, F.when(x.value * s.value < 0, "#NUM!").when(s.value == 0, "#DIV/0!"))


@compiles("ATAN2")
def _atan2(x, y):
    x, y = number(x), number(y)
    return finite(F.atan2(y.value, x.value), x, y, when_error((x.value == 0) & (y.value == 0), "#DIV/0!"))


# text


def whole(x: Column) -> Column:
    """A double as a 32-bit whole number, cut towards zero and held within its bounds: a cast must not fail the job."""
    return F.greatest(F.least(x, F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int")


def _count(t: Typed) -> Typed:
    n = number(t)
    return Typed(whole(n.value), "num", n.error)


def units(s: Column) -> Column:
    """The number of UTF-16 units, which lengths and places count: two for characters beyond the basic plane."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def cut(s: Column, start: Column, n: Column) -> Column:
    """``n`` units from ``start`` on. Where an end falls within a character of two units, that half is left out: no text can hold it."""
    raw = F.substring(F.encode(s, "UTF-16BE"), (start - 1) * 2 + 1, F.least(n, F.lit(1_000_000_000)) * 2)
    raw = F.when(F.hex(F.substring(raw, F.lit(1), F.lit(2))).between("DC00", "DFFF"), F.substring(raw, F.lit(3), F.octet_length(raw))).otherwise(raw)
    size = F.octet_length(raw)
    raw = F.when(F.hex(F.substring(raw, size - 1, F.lit(2))).between("D800", "DBFF"), F.substring(raw, F.lit(1), size - 2)).otherwise(raw)
    return F.when(units(s) == F.length(s), F.substring(s, start, n)).otherwise(F.decode(raw, "UTF-16BE"))


COMPILERS["LEN"] = lambda x: Typed(units(text(x).value).cast("double"), "num", x.error)
COMPILERS["UPPER"] = lambda x: Typed(F.upper(text(x).value), "text", x.error)
COMPILERS["LOWER"] = lambda x: Typed(F.lower(text(x).value), "text", x.error)
COMPILERS["TRIM"] = lambda x: Typed(F.trim(F.regexp_replace(text(x).value, " +", " ")), "text", x.error)
COMPILERS["CLEAN"] = lambda x: Typed(F.regexp_replace(text(x).value, r"[\x00-\x1f]", ""), "text", x.error)
# each run of letters: split before every run, capitalise, join
COMPILERS["PROPER"] = lambda x: Typed(F.array_join(F.transform(F.split(text(x).value, r"(?<![A-Za-z])(?=[A-Za-z])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), ""), "text", x.error)
COMPILERS["EXACT"] = lambda a, b: guarded(text(a).value == text(b).value, "bool", a, b)
COMPILERS["CONCATENATE"] = lambda *xs: guarded(F.concat(*[text(x).value for x in xs]), "text", *xs)
COMPILERS["CONCAT"] = COMPILERS["CONCATENATE"]


@compiles("LEFT")
def _left(x, n=_lit(1.0)):
    n = _count(n)
    return guarded(cut(text(x).value, F.lit(1), n.value), "text", x, n, when_error(n.value < 0, "#VALUE!"))


@compiles("RIGHT")
def _right(x, n=_lit(1.0)):
    n, s = _count(n), text(x).value
    return guarded(F.when(n.value <= 0, "").otherwise(cut(s, F.greatest(units(s) - n.value + 1, F.lit(1)), n.value)), "text", x, n, when_error(n.value < 0, "#VALUE!"))


@compiles("MID")
def _mid(x, start, n):
    start, n = _count(start), _count(n)
    return guarded(cut(text(x).value, F.greatest(start.value, F.lit(1)), F.greatest(n.value, F.lit(0))), "text", x, start, n, when_error((start.value < 1) | (n.value < 0), "#VALUE!"))


def place(at: Column, s: Column) -> Column:
    """A character's place in units, from its place in characters; 0 stays."""
    return F.when(at == 0, 0).otherwise(units(F.substring(s, F.lit(1), at - 1)) + 1)


@compiles("FIND")
def _find(needle, x, start=_lit(1.0)):
    s, k = text(x).value, int(float(_constant(start, "FIND")))
    rest = s if k <= 1 else cut(s, F.lit(k), units(s))
    at = place(F.instr(rest, text(needle).value), rest)
    return guarded((at + k - 1).cast("double"), "num", needle, x, when_error((at == 0) | F.lit(k < 1) | (units(s) + 1 < k), "#VALUE!"))


@compiles("SUBSTITUTE")
def _substitute(x, old, new, nth=None):
    s, o, n = text(x).value, text(old).value, text(new).value
    if nth is None:
        return guarded(F.when(o == "", s).otherwise(F.replace(s, o, n)), "text", x, old, new)
    k = _digits(nth)
    parts = F.split(s, F.concat(F.lit(r"\Q"), o, F.lit(r"\E")), -1)
    return guarded(F.when(F.size(parts) <= k, s).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), str(old.constant)), n, F.array_join(F.slice(parts, k + 1, 1_000_000), str(old.constant)))), "text", x, old, new)


@compiles("REPLACE")
def _replace(x, start, n, new):
    start, n, s = _count(start), _count(n), text(x).value
    return guarded(F.overlay(s, text(new).value, start.value, n.value), "text", x, start, n, new, when_error((start.value < 1) | (n.value < 0), "#VALUE!"))


@compiles("REPT")
def _rept(x, n):
    n = _count(n)
    return guarded(F.repeat(text(x).value, n.value), "text", x, n, when_error((n.value < 0) | (F.length(text(x).value).cast("bigint") * n.value > 32_767), "#VALUE!"))


@compiles("VALUE")
def _value(x):
    return Typed(F.lit(None).cast("double"), "num", F.lit("#VALUE!")) if x.kind == "bool" else number(x)


# logical


def _branches(*xs: Typed) -> str:
    kinds = {x.kind for x in xs if x.kind != "err"}
    if len(kinds) > 1:
        raise Refusal("ARG_UNSUPPORTED", f"branches of different types ({', '.join(sorted(kinds))}) have no column type", "IF")
    return next(iter(kinds), "num")


def chosen(cases: list[tuple[Typed, Typed]], other: Typed) -> Typed:
    """The first case whose test holds; an error in a test met on the way is the result."""
    kind = _branches(*[v for _, v in cases], other)
    value, error = other.value, other.error if other.error is not None else F.lit(None).cast("string")
    for test, then in reversed(cases):
        t = boolean(test)
        own = then.error if then.error is not None else F.lit(None).cast("string")
        value = F.when(t.value, then.value).otherwise(value)
        error = F.when(t.value, own).otherwise(error)
        if t.error is not None:
            error = F.coalesce(t.error, error)
    return guarded(value, kind, error)


def _fault(kind: str) -> Typed:
    return Typed(F.lit(None), "err", F.lit(kind))



COMPILERS["IF"] = lambda t, a, b=_lit(False): chosen([(t, a)], b)
COMPILERS["IFS"] = lambda *xs: chosen(list(zip(xs[::2], xs[1::2])), _fault("#N/A"))
COMPILERS["NOT"] = lambda x: guarded(~boolean(x).value, "bool", boolean(x))
COMPILERS["TRUE"] = lambda: _lit(True)
COMPILERS["FALSE"] = lambda: _lit(False)
COMPILERS["NA"] = lambda: _fault("#N/A")


@compiles("SWITCH")
def _switch(x, *xs):
    other = xs[-1] if len(xs) % 2 else _fault("#N/A")
    return chosen([(compared("=", x, c), v) for c, v in zip(xs[::2], xs[1::2])], other)


@compiles("CHOOSE")
def _choose(k, *xs):
    k = number(k)
    at = F.floor(k.value)
    return chosen([(Typed(at == i + 1, "bool", k.error), v) for i, v in enumerate(xs)], _fault("#VALUE!"))


def _trap(x: Typed, other: Typed, which: Column | None) -> Typed:
    if which is None:
        return Typed(x.value, _branches(x, other))
    kind = _branches(x, other)
    rest = other.error if other.error is not None else F.lit(None).cast("string")
    return guarded(F.when(which, other.value).otherwise(x.value), kind, F.when(which, rest).otherwise(x.error))


COMPILERS["IFERROR"] = lambda x, y: _trap(x, y, None if x.error is None else x.error.isNotNull())
COMPILERS["IFNA"] = lambda x, y: _trap(x, y, None if x.error is None else F.coalesce(x.error == "#N/A", F.lit(False)))


# information


def _no_error(x: Typed) -> Column:
    return F.lit(True) if x.error is None else x.error.isNull()


COMPILERS["ISBLANK"] = lambda x: Typed(x.value.isNull() & _no_error(x), "bool")
for _n, _k in (("ISNUMBER", "num"), ("ISTEXT", "text"), ("ISLOGICAL", "bool")):
    COMPILERS[_n] = lambda x, k=_k: Typed((x.value.isNotNull() & _no_error(x)) if x.kind == k else F.lit(False), "bool")
COMPILERS["ISNONTEXT"] = lambda x: Typed(~(x.value.isNotNull() & _no_error(x)) if x.kind == "text" else F.lit(True), "bool")
COMPILERS["ISERROR"] = lambda x: Typed(~_no_error(x), "bool")
COMPILERS["ISNA"] = lambda x: Typed(F.lit(False) if x.error is None else F.coalesce(x.error == "#N/A", F.lit(False)), "bool")
COMPILERS["ISERR"] = lambda x: Typed(F.lit(False) if x.error is None else F.coalesce(x.error != "#N/A", F.lit(False)), "bool")
COMPILERS["ISEVEN"] = lambda x: guarded(F.pmod(F.floor(F.abs(number(x).value)).cast("double"), F.lit(2.0)) == 0, "bool", number(x))
COMPILERS["ISODD"] = lambda x: guarded(F.pmod(F.floor(F.abs(number(x).value)).cast("double"), F.lit(2.0)) == 1, "bool", number(x))
COMPILERS["N"] = lambda x: Typed(F.coalesce(x.value.cast("double"), F.lit(0.0)) if x.kind in ("num", "bool") else F.lit(0.0), "num", x.error)
COMPILERS["T"] = lambda x: Typed(F.coalesce(x.value, F.lit("")) if x.kind == "text" else F.lit(""), "text", x.error)
COMPILERS["TYPE"] = lambda x: Typed(F.when(~_no_error(x), 16.0).when(x.value.isNull(), 1.0).otherwise({"num": 1.0, "text": 2.0, "bool": 4.0, "err": 16.0}[x.kind]), "num")


@compiles("ERROR.TYPE")
def _error_type(x):
    if x.error is None:
        return _fault("#N/A")
    kinds = F.array(*[F.lit(k) for k in ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A")])
    at = F.array_position(kinds, x.error)
    return guarded(at.cast("double"), "num", when_error(F.coalesce(at, F.lit(0)) == 0, "#N/A"))


# dates: serials of days from 1 March 1900 on


def date_of(serial: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), whole(F.floor(F.greatest(F.lit(0.0), F.least(serial.cast("double"), F.lit(2958465.0))))))


def serial_of(date: Column) -> Column:
    return F.datediff(date, F.lit("1899-12-30").cast("date")).cast("double")


def no_day(serial: Column) -> Column:
    return when_error((serial < 0) | (F.floor(serial) > 2958465), "#NUM!")


def _part(name: str, f) -> None:
    COMPILERS[name] = lambda x: guarded(f(date_of(number(x).value)).cast("double"), "num", number(x), no_day(number(x).value))


for _n, _f in (("YEAR", F.year), ("MONTH", F.month), ("DAY", F.dayofmonth)):
    _part(_n, _f)
COMPILERS["DAYS"] = lambda b, a: arithmetic("-", COMPILERS["INT"](b), COMPILERS["INT"](a))
COMPILERS["EDATE"] = lambda x, k: guarded(serial_of(F.add_months(date_of(number(x).value), _count(k).value)), "num", number(x), k)
COMPILERS["EOMONTH"] = lambda x, k: guarded(serial_of(F.last_day(F.add_months(date_of(number(x).value), _count(k).value))), "num", number(x), k)


@compiles("DATE")
def _date(y, m, d):
    y, m, d = _count(y), _count(m), _count(d)
    year = F.when((y.value >= 0) & (y.value < 1900), y.value + 1900).otherwise(y.value)
    return guarded(serial_of(F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), m.value - 1), d.value - 1)), "num", y, m, d)


@compiles("WEEKDAY")
def _weekday(x, kind=_lit(1.0)):
    first = {1: 6, 2: 0, 11: 0, 12: 1, 13: 2, 14: 3, 15: 4, 16: 5, 17: 6}
    k, day = _digits(kind), F.weekday(date_of(number(x).value))
    if k != 3 and k not in first:
        return _fault("#NUM!")
    return Typed((day if k == 3 else F.pmod(day - first[k], F.lit(7)) + 1).cast("double"), "num", number(x).error)


def _ymd(x: Column):
    d = date_of(x)
    return F.year(d), F.month(d), F.dayofmonth(d), F.dayofmonth(F.last_day(d))


@compiles("DAYS360")
def _days360(a, b, european=_lit(False)):
    a, b = number(a), number(b)
    (y1, m1, d1, l1), (y2, m2, d2, l2) = _ymd(a.value), _ymd(b.value)
    if european.constant:
        e1, e2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    else:
        e1 = F.when(d1 == l1, 30).otherwise(d1)
        e2 = F.when((d1 == l1) & (m1 == 2) & (m2 == 2) & (d2 == l2), 30).when((d2 == 31) & (e1 >= 30), 30).otherwise(d2)
    return guarded(((y2 - y1) * 360 + (m2 - m1) * 30 + e2 - e1).cast("double"), "num", a, b)


@compiles("DATEDIF")
def _datedif(a, b, unit):
    a, b = number(a), number(b)
    (y1, m1, d1, _), (y2, m2, d2, _) = _ymd(a.value), _ymd(b.value)
    months = (y2 - y1) * 12 + m2 - m1 - F.when(d2 < d1, 1).otherwise(0)
    days = F.floor(b.value) - F.floor(a.value)
    kinds = {"D": days, "M": months, "Y": F.floor(months / 12), "YM": months % 12}
    if (found := kinds.get(str(unit.constant).upper())) is None:
        raise Refusal("ARG_UNSUPPORTED", f"DATEDIF unit {unit.constant} is not compiled", "DATEDIF")
    return guarded(found.cast("double"), "num", a, b, when_error(b.value < a.value, "#NUM!"))


@compiles("YEARFRAC")
def _yearfrac(a, b, basis=_lit(0.0)):
    a, b, k = number(a), number(b), _digits(basis)
    low, high = F.least(a.value, b.value), F.greatest(a.value, b.value)
    if k in (0, 4):
        d = _days360(Typed(low, "num"), Typed(high, "num"), _lit(k == 4))
        return guarded(d.value / 360, "num", a, b)
    if k in (2, 3):
        return guarded((F.floor(high) - F.floor(low)) / (360 if k == 2 else 365), "num", a, b)
    raise Refusal("ARG_UNSUPPORTED", f"YEARFRAC basis {k} is not compiled", "YEARFRAC")


def working_days(a: Column, b: Column) -> Column:
    """Mondays to Fridays from serial a to serial b, both included, signed; closed form."""
    low, high = F.least(a, b), F.greatest(a, b)
    # working days up to serial n, counted from a Monday (serial 2 is one): 5 a week and the week's first five
    upto = lambda n: 5 * F.floor((n - 2) / 7) + F.least(F.pmod(n - 2, F.lit(7.0)) + 1, F.lit(5.0))
    return F.when(a <= b, 1).otherwise(-1) * (upto(high) - upto(low - 1))


COMPILERS["NETWORKDAYS"] = lambda a, b: guarded(working_days(F.floor(number(a).value), F.floor(number(b).value)).cast("double"), "num", number(a), number(b))


@compiles("WORKDAY")
def _workday(a, n):
    """Steps over working days by arithmetic; holidays need a calendar join and are not compiled."""
    a, k = number(a), _count(n)
    start, day = F.floor(a.value), F.weekday(date_of(a.value))
    # forwards from the Friday or weekday before, backwards from the Monday or weekday after
    back = F.when(day > 4, day - 4).otherwise(0)
    ahead = F.when(day > 4, 7 - day).otherwise(0)
    w1 = F.when(day > 4, 4).otherwise(day)
    w2 = F.when(day > 4, 0).otherwise(day)
    forward = start - back + F.floor((w1 + k.value) / 5) * 7 + F.pmod(w1 + k.value, F.lit(5)) - w1
    backward = start + ahead + F.floor((w2 + k.value) / 5) * 7 + F.pmod(w2 + k.value, F.lit(5)) - w2
    return guarded(F.when(k.value > 0, forward).when(k.value < 0, backward).otherwise(start).cast("double"), "num", a, k)


# finance


def _nums(*xs: Typed) -> list[Typed]:
    return [number(x) for x in xs]


def pmt_column(r, n, pv, fv, due) -> Column:
    g = let(F.pow(1 + r, n))
    return F.when(r == 0, F.try_divide(-(pv + fv), n)).otherwise(F.try_divide(-r * (pv * g + fv), (1 + r * due) * (g - 1)))


def fv_column(r, n, payment, pv, due) -> Column:
    g = F.pow(1 + r, n)  # also within folds over periods, which cannot name it
    return F.when(r == 0, -(pv + payment * n)).otherwise(-(pv * g + F.try_divide(payment * (1 + r * due) * (g - 1), r)))


@compiles("PMT")
def _pmt(r, n, pv, fv=_lit(0.0), due=_lit(0.0)):
    r, n, pv, fv, due = _nums(r, n, pv, fv, due)
    t = F.when(due.value != 0, 1.0).otherwise(0.0)
    return finite(let(pmt_column(r.value, n.value, pv.value, fv.value, t)), r, n, pv, fv, due, when_error(n.value == 0, "#NUM!"))


@compiles("FV")
def _fv(r, n, p, pv=_lit(0.0), due=_lit(0.0)):
    r, n, p, pv, due = _nums(r, n, p, pv, due)
    return finite(let(fv_column(r.value, n.value, p.value, pv.value, F.when(due.value != 0, 1.0).otherwise(0.0))), r, n, p, pv, due)


@compiles("PV")
def _pv(r, n, p, fv=_lit(0.0), due=_lit(0.0)):
    r, n, p, fv, due = _nums(r, n, p, fv, due)
    t, g = F.when(due.value != 0, 1.0).otherwise(0.0), let(F.pow(1 + r.value, n.value))
    v = F.when(r.value == 0, -(fv.value + p.value * n.value)).otherwise(-(fv.value + F.try_divide(p.value * (1 + r.value * t) * (g - 1), r.value)) / g)
    return finite(let(v), r, n, p, fv, due)


@compiles("NPER")
def _nper(r, p, pv, fv=_lit(0.0), due=_lit(0.0)):
    r, p, pv, fv, due = _nums(r, p, pv, fv, due)
    a = F.try_divide(p.value * (1 + r.value * F.when(due.value != 0, 1.0).otherwise(0.0)), r.value)
    q = let(F.try_divide(a - fv.value, a + pv.value))
    bad = let(F.when(r.value == 0, p.value == 0).otherwise(F.coalesce(q <= 0, F.lit(True)) | (r.value <= -1)))
    return finite(let(F.when(r.value == 0, F.try_divide(-(pv.value + fv.value), p.value)).when(~bad, F.log(q) / F.log1p(r.value))), r, p, pv, fv, due, when_error(bad, "#NUM!"))


def _split(interest: bool):
    def build(r, k, n, pv, fv=_lit(0.0), due=_lit(0.0)):
        r, k, n, pv, fv, due = _nums(r, k, n, pv, fv, due)
        t = F.when(due.value != 0, 1.0).otherwise(0.0)
        payment = let(pmt_column(r.value, n.value, pv.value, fv.value, t))
        part = let(F.when((t == 1) & (k.value == 1), 0.0).otherwise(fv_column(r.value, k.value - 1, payment, pv.value, t) * r.value))
        return finite(part if interest else payment - part, r, k, n, pv, fv, due, when_error((k.value < 1) | (k.value > n.value), "#NUM!"))

    return build


COMPILERS["IPMT"], COMPILERS["PPMT"] = _split(True), _split(False)


@compiles("SLN")
def _sln(cost, salvage, life):
    c, s, n = _nums(cost, salvage, life)
    return finite(F.try_divide(c.value - s.value, n.value), c, s, n, when_error(n.value == 0, "#DIV/0!"))


@compiles("SYD")
def _syd(cost, salvage, life, per):
    c, s, n, k = _nums(cost, salvage, life, per)
    return finite((c.value - s.value) * (n.value - k.value + 1) * 2 / (n.value * (n.value + 1)), c, s, n, k, when_error((n.value <= 0) | (k.value < 1) | (k.value > n.value), "#NUM!"))


@compiles("DDB")
def _ddb(cost, salvage, life, per, factor=_lit(2.0)):
    c, s, n, k, f = _nums(cost, salvage, life, per, factor)
    bad = (n.value <= 0) | (k.value < 1)
    state = F.struct(c.value.alias("left"), F.lit(0.0).alias("part"))

    def step(acc, _):
        part = F.greatest(F.lit(0.0), F.least(acc["left"] * f.value / n.value, acc["left"] - s.value))
        return F.struct((acc["left"] - part).alias("left"), part.alias("part"))

    steps = F.when(~bad, F.sequence(F.lit(1), whole(F.ceil(k.value))))
    return finite(F.aggregate(steps, state, step, lambda acc: acc["part"]), c, s, n, k, f, when_error(bad, "#NUM!"))


@compiles("EFFECT")
def _effect(r, n):
    r, n = _nums(r, n)
    m = F.floor(n.value)
    return finite(F.when(m >= 1, F.pow(1 + r.value / m, m) - 1), r, n, when_error((r.value <= 0) | (m < 1), "#NUM!"))


@compiles("NOMINAL")
def _nominal(r, n):
    r, n = _nums(r, n)
    m = F.floor(n.value)
    return finite(F.when(m >= 1, m * (F.pow(1 + r.value, 1 / m) - 1)), r, n, when_error((r.value <= 0) | (m < 1), "#NUM!"))


@compiles("RRI")
def _rri(n, a, b):
    n, a, b = _nums(n, a, b)
    return finite(F.when((a.value == 0) & (b.value == 0), 0.0).otherwise(F.pow(F.try_divide(b.value, a.value), F.try_divide(F.lit(1.0), n.value)) - 1), n, a, b, when_error((n.value <= 0) | (a.value == 0) & (b.value != 0), "#NUM!"))


@compiles("PDURATION")
def _pduration(r, a, b):
    r, a, b = _nums(r, a, b)
    bad = (r.value <= 0) | (a.value <= 0) | (b.value <= 0)
    return finite(F.when(~bad, (F.log(b.value) - F.log(a.value)) / F.log1p(r.value)), r, a, b, when_error(bad, "#NUM!"))

# more text


def _constant(t: Typed, what: str):
    if t.constant is None:
        raise Refusal("ARG_UNSUPPORTED", f"{what} must be a constant to have a column form", what)
    return t.constant


@compiles("CHAR")
def _char(x):
    n = _count(x)
    return guarded(F.decode(F.unhex(F.lpad(F.hex(n.value), 2, "0")), "ISO-8859-1"), "text", n, when_error((n.value < 1) | (n.value > 255), "#VALUE!"))


@compiles("UNICHAR")
def _unichar(x):
    n = _count(x)
    bad = (n.value < 1) | (n.value > 0x10FFFF) | n.value.between(0xD800, 0xDFFF)
    return guarded(F.decode(F.unhex(F.lpad(F.hex(F.when(~bad, n.value)), 8, "0")), "UTF-32"), "text", n, when_error(bad, "#VALUE!"))


COMPILERS["UNICODE"] = lambda x: guarded(F.conv(F.hex(F.encode(F.substring(text(x).value, 1, 1), "UTF-32")), 16, 10).cast("double"), "num", x, when_error(text(x).value == "", "#VALUE!"))
COMPILERS["CODE"] = lambda x: guarded(F.conv(F.substring(F.hex(F.encode(F.substring(text(x).value, 1, 1), "UTF-16BE")), 1, 4), 16, 10).cast("double"), "num", x, when_error(text(x).value == "", "#VALUE!"))


@compiles("SEARCH")
def _search(needle, x, start=_lit(1.0)):
    pattern, k = str(_constant(needle, "SEARCH")), int(float(_constant(start, "SEARCH")))
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            i += 1
            out.append("\\" + pattern[i])
        else:
            out.append({"*": ".*", "?": "."}.get(c) or ("\\" + c if c in r"\.[]{}()+-^$|/" else c))
        i += 1
    s = text(x).value
    rest = s if k <= 1 else cut(s, F.lit(k), units(s))
    at = place(F.regexp_instr(rest, F.lit("(?is)" + "".join(out))), rest)
    return guarded((at + k - 1).cast("double"), "num", needle, x, when_error((at == 0) | (units(s) + 1 < k) | F.lit(k < 1), "#VALUE!"))


def _grouped(x: Column, digits: int, comma: bool) -> Column:
    """A rounded number with fixed decimals, and thousands commas if asked for."""
    r = rounded(x, digits)
    shown = F.format_number(F.abs(r).try_cast("decimal(38,15)"), max(0, digits))
    shown = shown if comma else F.translate(shown, ",", "")
    return F.concat(F.when(r < 0, "-").otherwise(""), shown)


@compiles("FIXED")
def _fixed(x, digits=_lit(2.0), plain=_lit(False)):
    x = number(x)
    return guarded(_grouped(x.value, _digits(digits), not _constant(plain, "FIXED")), "text", x)


@compiles("DOLLAR")
def _dollar(x, digits=_lit(2.0)):
    x, d = number(x), _digits(digits)
    shown = F.concat(F.lit("$"), _grouped(F.abs(x.value), d, True))
    return guarded(F.when(rounded(x.value, d) < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown), "text", x)


@compiles("TEXTJOIN")
def _textjoin(by, skip, *xs):
    parts = F.array(*[text(x).value for x in xs])
    keep = True if skip.constant is None else bool(skip.constant)
    return guarded(F.array_join(F.filter(parts, lambda p: p != "") if keep else parts, str(_constant(by, "TEXTJOIN"))), "text", by, skip, *xs)


@compiles("NUMBERVALUE")
def _numbervalue(x, decimal=_lit("."), group=_lit(",")):
    d, g = str(_constant(decimal, "NUMBERVALUE"))[:1], str(_constant(group, "NUMBERVALUE"))[:1]
    bare = F.regexp_replace(text(x).value, r"\s", "")
    whole, rest = F.substring_index(bare, d, 1), F.when(F.instr(bare, d) > 0, F.substring_index(bare, d, -1)).otherwise("")
    n = parsed_number(F.concat(F.replace(whole, F.lit(g), F.lit("")), F.when(F.instr(bare, d) > 0, ".").otherwise(""), rest))
    return guarded(F.when(bare == "", 0.0).otherwise(n), "num", x, when_error((bare != "") & (n.isNull() | (F.instr(rest, g) > 0)), "#VALUE!"))


_TEXT_NUMBER = {"0": (0, False, False), "0.0": (1, False, False), "0.00": (2, False, False), "0.000": (3, False, False), "#,##0": (0, True, False), "#,##0.0": (1, True, False), "#,##0.00": (2, True, False), "0%": (0, False, True), "0.0%": (1, False, True), "0.00%": (2, False, True)}
_TEXT_DATE = {"yyyy-mm-dd": "yyyy-MM-dd", "yyyy-mm": "yyyy-MM", "yyyymm": "yyyyMM", "mmm-yy": "MMM-yy", "d mmm yyyy": "d MMM yyyy", "yyyy": "yyyy"}


@compiles("TEXT")
def _text(x, code):
    """TEXT with the codes above; others are refused, as in cell mode those that its formatter does not know."""
    known = str(_constant(code, "TEXT"))
    n = number(x)
    if known in _TEXT_NUMBER:
        digits, comma, percent = _TEXT_NUMBER[known]
        shown = F.concat(_grouped(n.value * 100 if percent else n.value, digits, comma), F.lit("%" if percent else ""))
    elif known in _TEXT_DATE:
        shown = F.date_format(date_of(n.value), _TEXT_DATE[known])
    elif set(known) == {"0"}:
        shown = F.concat(F.when(rounded(n.value, 0) < 0, "-").otherwise(""), F.lpad(F.abs(rounded(n.value, 0)).try_cast("decimal(38,0)").cast("string"), len(known), "0"))
    else:
        raise Refusal("FEATURE", f"number format {known} is not supported", "TEXT")
    if x.kind == "text":  # text that is no number passes through
        return Typed(F.when(x.value.isNotNull() & parsed_number(x.value).isNull(), x.value).otherwise(shown), "text", x.error)
    return guarded(shown, "text", n)


# times of day


def _cut(t: Typed) -> Column:
    x = number(t).value
    return F.signum(x) * F.floor(F.abs(x))


COMPILERS["TIME"] = lambda h, m, s: (lambda t: guarded(F.pmod(t / 86400, F.lit(1.0)), "num", h, m, s, when_error(t < 0, "#NUM!")))(_cut(h) * 3600 + _cut(m) * 60 + _cut(s))


def _clock(x: Typed) -> tuple[Typed, Column]:
    x = number(x)
    return x, F.pmod(F.round((x.value - F.floor(x.value)) * 86400), F.lit(86400.0))


def _clock_part(f):
    def build(x):
        x, seconds = _clock(x)
        return guarded(f(seconds).cast("double"), "num", x, when_error(x.value < 0, "#NUM!"))

    return build


COMPILERS["HOUR"] = _clock_part(lambda s: F.floor(s / 3600))
COMPILERS["MINUTE"] = _clock_part(lambda s: F.floor(s / 60) % 60)
COMPILERS["SECOND"] = _clock_part(lambda s: s % 60)


@compiles("DATEVALUE")
def _datevalue(x):
    s = F.trim(text(x).value)
    d = F.coalesce(F.try_to_date(F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s), "yyyy-M-d"), F.try_to_date(F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), s), "M/d/yyyy"))
    return guarded(serial_of(d), "num", x, when_error(d.isNull(), "#VALUE!"))


@compiles("TIMEVALUE")
def _timevalue(x):
    s, part = text(x).value, lambda k: F.coalesce(F.regexp_extract(text(x).value, r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$", k).try_cast("double"), F.lit(0.0))
    return guarded(F.pmod((part(1) * 3600 + part(2) * 60 + part(3)) / 86400, F.lit(1.0)), "num", x, when_error(~s.rlike(r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$"), "#VALUE!"))


# more math


@compiles("FACT")
def _fact(x):
    x = number(x)
    table = F.array(*[F.lit(float(math.factorial(k))) for k in range(171)])
    bad = (x.value < 0) | (x.value >= 171)
    return guarded(F.element_at(table, F.when(~bad, whole(F.floor(x.value)) + 1)), "num", x, when_error(bad, "#NUM!"))


@compiles("COMBIN")
def _combin(n, k):
    n, k = _count(n), _count(k)
    bad = (n.value < 0) | (k.value < 0) | (k.value > n.value)
    small = F.least(k.value, n.value - k.value)
    steps = F.when(~bad & (small > 0), F.sequence(F.lit(1), small)).otherwise(F.array().cast("array<int>"))
    return finite(F.round(F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (n.value - small + i) / i), 0), n, k, when_error(bad, "#NUM!"))


def _math_steps(up: bool):
    def build(x, s=_lit(1.0), mode=_lit(0.0)):
        x, s, m = number(x), number(s), number(mode)
        size = F.abs(s.value)
        away = (m.value != 0) & (x.value < 0)
        out = F.when(away, _steps(x.value, size, not up)).otherwise(_steps(x.value, size, up))
        return finite(F.when(size == 0, 0.0).otherwise(out), x, s, m)

    return build


COMPILERS["CEILING.MATH"], COMPILERS["FLOOR.MATH"] = _math_steps(True), _math_steps(False)


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, as many as 53-bit numbers can need."""
    start = F.struct(a.alias("a"), b.alias("b"))
    step = lambda acc, _: F.struct(F.when(acc["b"] == 0, acc["a"]).otherwise(acc["b"]).alias("a"), F.when(acc["b"] == 0, F.lit(0.0)).otherwise(acc["a"] - acc["b"] * F.floor(F.try_divide(acc["a"], acc["b"]))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda acc: acc["a"])


def _folding(join, first: float):
    def build(*xs):
        ns = [number(x) for x in xs]
        out = F.lit(first)
        for n in ns:
            out = join(out, F.floor(n.value).cast("double"))
        return finite(out, *ns, *[when_error(n.value < 0, "#NUM!") for n in ns])

    return build


COMPILERS["GCD"] = _folding(lambda a, b: _gcd(a, b), 0.0)
COMPILERS["LCM"] = _folding(lambda a, b: F.when((a == 0) | (b == 0), 0.0).otherwise(F.try_divide(a * b, _gcd(a, b))), 1.0)


# more finance


def _cumulated(interest: bool):
    def build(r, n, pv, a, b, due):
        r, n, pv, a, b, due = _nums(r, n, pv, a, b, due)
        first, last = F.floor(a.value), F.floor(b.value)
        bad = (r.value <= 0) | (n.value <= 0) | (pv.value <= 0) | (first < 1) | (last < first) | (last > n.value) | ~due.value.isin(0.0, 1.0)
        payment = pmt_column(r.value, n.value, pv.value, F.lit(0.0), due.value)
        part = lambda k: F.when((due.value == 1) & (k == 1), 0.0).otherwise(fv_column(r.value, k - 1, payment, pv.value, due.value) * r.value)
        total = F.aggregate(F.when(~bad, F.sequence(whole(first), whole(last))), F.lit(0.0), lambda acc, k: acc + part(k))
        return finite(total if interest else payment * (last - first + 1) - total, r, n, pv, a, b, due, when_error(bad, "#NUM!"))

    return build


COMPILERS["CUMIPMT"], COMPILERS["CUMPRINC"] = _cumulated(True), _cumulated(False)



# normal distribution

#: Step and number of nodes of the midpoint rule below; with both its error is beyond a double's last place.
_STEP, _NODES = 0.5, 13


def _upper_tail(z: Column) -> Column:
    """P(normal > z), z not negative: the midpoint rule on the integral of exp(-t t) / (t t + x x), x = z / sqrt(2), and what its pole adds.

    A fixed sum of quotients, so it stays in generated code; its relative error is about 1e-15 as far as doubles go.
    """
    x = z / math.sqrt(2)
    square = x * x
    nodes = [((k + 0.5) * _STEP) ** 2 for k in range(_NODES)]
    total = functools.reduce(operator.add, [math.exp(-t) / (square + t) for t in nodes])
    pole = F.when(x < math.pi / _STEP, 1.0 / (1 + F.exp(x * (2 * math.pi / _STEP)))).otherwise(0.0)
    return total * x * F.exp(-square) * (_STEP / math.pi) + pole


def _normal_cdf(z: Column) -> Column:
    z = let(z)
    tail = let(_upper_tail(F.abs(z)))
    return F.when(z < 0, tail).otherwise(1 - tail)


def _normal_pdf(z: Column) -> Column:
    z = let(z)
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _normal_inverse(p: Column) -> Column:
    """A closed guess for the smaller tail, then three of Halley's steps; p must be above 0 and below 1."""
    p = let(p)
    q = let(F.least(p, 1 - p))
    spread = F.ln(F.nullif(F.greatest(4 * q * (1 - q), F.lit(0.0)), F.lit(0.0)))
    half = let(2 / (math.pi * 0.147) + spread / 2)
    guess = F.sqrt(F.greatest(F.lit(0.0), 2 * (F.sqrt(half * half - spread / 0.147) - half)))

    def step(z, _):
        miss = F.try_divide(_upper_tail(z) - q, F.exp(-z * z / 2) / math.sqrt(2 * math.pi))
        return F.aggregate(F.array(miss), z, lambda at, u: F.greatest(F.lit(0.0), at + F.try_divide(u, 1 - u * at / 2)))

    z = let(F.aggregate(F.sequence(F.lit(1), F.lit(3)), guess, step))
    return F.when(p < 0.5, -z).otherwise(z)


@compiles("NORM.S.DIST")
def _norm_s_dist(z, cumulative):
    z, c = number(z), boolean(cumulative)
    return guarded(F.when(c.value, _normal_cdf(z.value)).otherwise(_normal_pdf(z.value)), "num", z, c)


@compiles("NORMSDIST")
def _normsdist(z):
    z = number(z)
    return guarded(_normal_cdf(z.value), "num", z)


@compiles("NORM.DIST")
def _norm_dist(x, mean, deviation, cumulative):
    (x, m, s), c = _nums(x, mean, deviation), boolean(cumulative)
    z = F.try_divide(x.value - m.value, s.value)
    return guarded(F.when(c.value, _normal_cdf(z)).otherwise(F.try_divide(_normal_pdf(z), s.value)), "num", x, m, s, when_error(s.value <= 0, "#NUM!"), c)


def _outside(p: Typed) -> Column:
    return when_error((p.value <= 0) | (p.value >= 1), "#NUM!")


@compiles("NORM.S.INV NORMSINV")
def _norm_s_inv(p):
    p = number(p)
    return guarded(_normal_inverse(p.value), "num", p, _outside(p))


@compiles("NORM.INV")
def _norm_inv(p, mean, deviation):
    p, m, s = _nums(p, mean, deviation)
    return guarded(m.value + s.value * _normal_inverse(p.value), "num", p, m, s, when_error(s.value <= 0, "#NUM!"), _outside(p))
