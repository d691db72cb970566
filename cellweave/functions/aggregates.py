"""Aggregates, statistics, and conditional aggregates with their criteria language."""

from __future__ import annotations

import math
import re
from statistics import NormalDist

from ..formula.values import DIV0, MAX_COLS, MAX_ROWS, NA, NUM, REF, VALUE, Err, Failed, Refusal, compare, parse_number, rank, to_text
from .registry import MISSING, Area, Grid, define, grid_of, is_range, numbers, numbers_a, values_of
from .scalars import has_wildcard, wildcard


def mean(xs: list[float]) -> float:
    if not xs:
        raise Failed(DIV0)
    return sum(xs) / len(xs)


def variance(xs: list[float], population: bool = False) -> float:
    n = len(xs) if population else len(xs) - 1
    if n < 1:
        raise Failed(DIV0)
    m = mean(xs)
    return sum((x - m) ** 2 for x in xs) / n


def median(xs: list[float]) -> float:
    if not xs:
        raise Failed(NUM)
    xs, h = sorted(xs), len(xs) // 2
    return xs[h] if len(xs) % 2 else (xs[h - 1] + xs[h]) / 2


def percentile(xs: list[float], p: float, exclusive: bool = False) -> float:
    xs, n = sorted(xs), len(xs)
    if not xs or not 0 <= p <= 1:
        raise Failed(NUM)
    at = p * (n + 1) - 1 if exclusive else p * (n - 1)
    if exclusive and not 1 / (n + 1) <= p <= n / (n + 1):
        raise Failed(NUM)
    k = min(math.floor(at), n - 1)
    return xs[k] + (at - k) * (xs[min(k + 1, n - 1)] - xs[k])


_REDUCE = {
    "SUM": sum,
    "PRODUCT": lambda xs: math.prod(xs) if xs else 0,
    "SUMSQ": lambda xs: sum(x * x for x in xs),
    "AVERAGE": mean,
    "MIN": lambda xs: min(xs, default=0),
    "MAX": lambda xs: max(xs, default=0),
    "MEDIAN": median,
    "STDEV": lambda xs: math.sqrt(variance(xs)),
    "STDEV.P": lambda xs: math.sqrt(variance(xs, True)),
    "VAR": variance,
    "VAR.P": lambda xs: variance(xs, True),
}
for _names, _key in (("SUM", "SUM"), ("PRODUCT", "PRODUCT"), ("SUMSQ", "SUMSQ"), ("AVERAGE", "AVERAGE"), ("MIN", "MIN"), ("MAX", "MAX"), ("MEDIAN", "MEDIAN"), ("STDEV STDEV.S", "STDEV"), ("STDEV.P STDEVP", "STDEV.P"), ("VAR VAR.S", "VAR"), ("VAR.P VARP", "VAR.P")):
    define(_names, 1, -1)(lambda call, *args, f=_REDUCE[_key]: f(numbers(args)))
for _names, _key in (("AVERAGEA", "AVERAGE"), ("MINA", "MIN"), ("MAXA", "MAX")):
    define(_names, 1, -1)(lambda call, *args, f=_REDUCE[_key]: f(numbers_a(args)))


def count(args) -> int:
    n = 0
    for arg in args:
        for v in values_of(arg):
            if is_range(arg):
                n += isinstance(v, float)
            else:
                n += isinstance(v, (bool, float)) or isinstance(v, str) and parse_number(v) is not None
    return n


@define("COUNT", 1, -1)
def _count(call, *args):
    return count(args)


@define("COUNTA", 1, -1)
def _counta(call, *args):
    for a in args:
        if a == REF and isinstance(a, Err):
            return a
    return sum(v is not None for a in args for v in values_of(a))


define("COUNTBLANK", 1)(lambda call, x: sum(v is None or v == "" and isinstance(v, str) for v in grid_of(x).flat()))

#: SUBTOTAL's codes.
_SUBTOTAL = {1: "AVERAGE", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV", 8: "STDEV.P", 9: "SUM", 10: "VAR", 11: "VAR.P"}


@define("SUBTOTAL", 2, -1)
def _subtotal(call, code, *args):
    code = math.trunc(call.number(code))
    if 101 <= code <= 111:
        raise Refusal("ARG_UNSUPPORTED", "SUBTOTAL over visible rows needs to know which rows are hidden", "SUBTOTAL")
    if code in (2, 3):
        return count(args)
    if code not in _SUBTOTAL:
        raise Failed(VALUE)
    return _REDUCE[_SUBTOTAL[code]](numbers(args))


@define("SUMPRODUCT", 1, -1, arrays=True)
def _sumproduct(call, *args):
    grids = [grid_of(a) for a in args]
    if any((g.height, g.width) != (grids[0].height, grids[0].width) for g in grids):
        raise Failed(VALUE)
    total = 0.0
    for row in zip(*(g.flat() for g in grids)):
        product = 1.0
        for v in row:
            if isinstance(v, Err):
                raise Failed(v)
            product *= float(v) if isinstance(v, (bool, float)) else 0.0
        total += product
    return total


def _kth(largest: bool):
    def body(call, xs, k):
        xs, k = sorted(numbers([xs]), reverse=largest), math.ceil(call.number(k))
        if not 1 <= k <= len(xs):
            raise Failed(NUM)
        return xs[k - 1]

    return body


define("LARGE", 2)(_kth(True))
define("SMALL", 2)(_kth(False))
define("PERCENTILE PERCENTILE.INC", 2)(lambda call, xs, p: percentile(numbers([xs]), call.number(p)))
define("PERCENTILE.EXC", 2)(lambda call, xs, p: percentile(numbers([xs]), call.number(p), True))


def _quartile(exclusive: bool):
    def body(call, xs, k):
        k = math.trunc(call.number(k))
        if not 0 <= k <= 4:
            raise Failed(NUM)
        return percentile(numbers([xs]), k / 4, exclusive)

    return body


define("QUARTILE QUARTILE.INC", 2)(_quartile(False))
define("QUARTILE.EXC", 2)(_quartile(True))


@define("RANK RANK.EQ", 2, 3)
def _rank(call, x, xs, ascending=0.0):
    x, xs, up = call.number(x), numbers([xs]), call.number(ascending) != 0
    if x not in xs:
        return NA
    return 1 + sum(y < x if up else y > x for y in xs)


def _pairs(a, b) -> tuple[list[float], list[float]]:
    a, b = grid_of(a).flat(), grid_of(b).flat()
    if len(a) != len(b):
        raise Failed(NA)
    for v in (*a, *b):
        if isinstance(v, Err):
            raise Failed(v)
    both = [(x, y) for x, y in zip(a, b) if isinstance(x, float) and isinstance(y, float)]
    return [x for x, _ in both], [y for _, y in both]


def _moments(ys, xs) -> tuple[float, float, float, float, float]:
    my, mx = mean(ys), mean(xs)
    return my, mx, sum((y - my) ** 2 for y in ys), sum((x - mx) ** 2 for x in xs), sum((x - mx) * (y - my) for x, y in zip(xs, ys))


def _correl(ys, xs) -> float:
    _, _, syy, sxx, sxy = _moments(ys, xs)
    if syy == 0 or sxx == 0:
        raise Failed(DIV0)
    return sxy / math.sqrt(syy * sxx)


def _line(ys, xs) -> tuple[float, float]:
    my, mx, _, sxx, sxy = _moments(ys, xs)
    if sxx == 0:
        raise Failed(DIV0)
    return sxy / sxx, my - sxy / sxx * mx


define("CORREL", 2)(lambda call, a, b: _correl(*_pairs(a, b)))
define("RSQ", 2)(lambda call, y, x: _correl(*_pairs(y, x)) ** 2)
define("SLOPE", 2)(lambda call, y, x: _line(*_pairs(y, x))[0])
define("INTERCEPT", 2)(lambda call, y, x: _line(*_pairs(y, x))[1])


@define("FORECAST FORECAST.LINEAR", 3)
def _forecast(call, x, ys, xs):
    ys, xs = _pairs(ys, xs)
    slope, cut = _line(ys, xs)
    return cut + slope * call.number(x)


# ---- normal distribution -----------------------------------------------------------------------------------------------


def normal_cdf(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def normal_pdf(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_inverse(p: float) -> float:
    if not 0 < p < 1:
        raise Failed(NUM)
    return NormalDist().inv_cdf(p)


define("NORM.S.DIST", 2)(lambda call, z, c: normal_cdf(call.number(z)) if call.boolean(c) else normal_pdf(call.number(z)))
define("NORMSDIST", 1)(lambda call, z: normal_cdf(call.number(z)))


@define("NORM.DIST", 4)
def _norm_dist(call, x, m, s, c):
    x, m, s = call.number(x), call.number(m), call.number(s)
    if s <= 0:
        raise Failed(NUM)
    return normal_cdf((x - m) / s) if call.boolean(c) else normal_pdf((x - m) / s) / s


define("NORM.S.INV NORMSINV", 1)(lambda call, p: normal_inverse(call.number(p)))


@define("NORM.INV", 3)
def _norm_inv(call, p, m, s):
    p, m, s = call.number(p), call.number(m), call.number(s)
    if s <= 0:
        raise Failed(NUM)
    return m + s * normal_inverse(p)


# ---- criteria ----------------------------------------------------------------------------------------------------------

_CRITERION = re.compile(r"(<=|>=|<>|=|<|>)?(.*)", re.S)


def split_criterion(text: str) -> tuple[str, object]:
    """(operator, operand) of a criterion's text; no operator is '' and means equality."""
    op, rest = _CRITERION.fullmatch(text).groups()
    n = parse_number(rest) if rest else None
    return op or "", n if n is not None else rest.upper() == "TRUE" if rest.upper() in ("TRUE", "FALSE") else rest


def criterion(c):
    """The test that a criterion makes of a cell's value."""
    if c is None or c is MISSING or c == "" and isinstance(c, str):
        return lambda v: v is None or v == "" and isinstance(v, str)
    if not isinstance(c, str):
        return (lambda v: v == c) if isinstance(c, Err) else (lambda v: not isinstance(v, Err) and compare(v, c) == 0)
    op, x = split_criterion(c)
    if x == "" and isinstance(x, str):
        blank = lambda v: v is None or v == "" and isinstance(v, str)
        if op in ("=", ""):
            return blank
        if op == "<>":
            return lambda v: not blank(v)
    if op in ("", "=", "<>"):
        if isinstance(x, str) and has_wildcard(x):
            pattern = wildcard(x)
            hit = lambda v: v is not None and not isinstance(v, (Err, bool)) and bool(pattern.match(to_text(v)))
        else:
            hit = lambda v: v is not None and not isinstance(v, Err) and rank(v) == rank(x) and compare(v, x) == 0
        return (lambda v: not hit(v)) if op == "<>" else hit
    ordered = {"<": lambda d: d < 0, ">": lambda d: d > 0, "<=": lambda d: d <= 0, ">=": lambda d: d >= 0}[op]
    return lambda v: v is not None and not isinstance(v, Err) and rank(v) == rank(x) and ordered(compare(v, x))


def _aligned(call, area, like: Grid):
    """A range read from its top left corner in another's shape."""
    if isinstance(area, Area):
        if area.top + like.height - 1 > MAX_ROWS or area.left + like.width - 1 > MAX_COLS:
            raise Failed(REF)
        return area.book.grid(Area(area.book, area.sheet, area.top, area.left, area.top + like.height - 1, area.left + like.width - 1, like.height, like.width))
    grid = grid_of(area)
    return Grid([[grid.rows[i][j] if i < grid.height and j < grid.width else None for j in range(like.width)] for i in range(like.height)])


def _chosen(call, pairs, spread: bool = True):
    """For each criteria set (more than one where criteria are arrays): the flags of the cells that meet all."""
    grids = [_declared(a) for a, _ in pairs]
    if any((g.height, g.width) != (grids[0].height, grids[0].width) for g in grids):
        raise Failed(VALUE)
    cells = [g.flat() for g in grids]

    def flags(criteria):
        tests = [criterion(c) for c in criteria]
        return [all(t(v) for t, v in zip(tests, row)) for row in zip(*cells)]

    wide = [grid_of(c) if isinstance(c, Grid) or isinstance(c, Area) and call.arrays else None for _, c in pairs] if spread else [None] * len(pairs)
    if not any(wide):
        return grids[0], flags([_first(call, c) for _, c in pairs]), None
    shape = next(w for w in wide if w)
    sets = [[w.flat()[k] if w else call.scalar(c) for w, (_, c) in zip(wide, pairs)] for k in range(shape.height * shape.width)]
    return grids[0], [flags(s) for s in sets], shape


def _first(call, c):
    return c.rows[0][0] if isinstance(c, Grid) and c.height and c.width else call.scalar(c)


def _declared(arg) -> Grid:
    if not is_range(arg):
        if isinstance(arg, Err):
            raise Failed(arg)
        raise Failed(VALUE)
    return grid_of(arg)


def _spread(found, shape, f):
    if shape is None:
        return f(found)
    flat = [f(flags) for flags in found]
    return Grid([flat[i * shape.width : (i + 1) * shape.width] for i in range(shape.height)])


def _picked(values: list, flags: list[bool]) -> list[float]:
    out = []
    for v, f in zip(values, flags):
        if f:
            if isinstance(v, Err):
                raise Failed(v)
            if isinstance(v, float):
                out.append(v)
    return out


@define("COUNTIF", 2)
def _countif(call, area, c):
    _, found, shape = _chosen(call, [(area, c)])
    return _spread(found, shape, lambda flags: float(sum(flags)))


@define("COUNTIFS", 2, -1)
def _countifs(call, *args):
    if len(args) % 2:
        return VALUE
    _, found, shape = _chosen(call, list(zip(args[::2], args[1::2])))
    return _spread(found, shape, lambda flags: float(sum(flags)))


@define("SUMIF", 2, 3)
def _sumif(call, area, c, sums=MISSING):
    grid, found, shape = _chosen(call, [(area, c)])
    values = (grid if sums is MISSING else _aligned(call, sums, grid)).flat()
    return _spread(found, shape, lambda flags: float(sum(_picked(values, flags))))


@define("AVERAGEIF", 2, 3)
def _averageif(call, area, c, sums=MISSING):
    grid, found, _ = _chosen(call, [(area, c)], False)
    return mean(_picked((grid if sums is MISSING else _aligned(call, sums, grid)).flat(), found))


def _ifs_family(f):
    def body(call, target, *args):
        if len(args) % 2:
            return VALUE
        grid, found, _ = _chosen(call, list(zip(args[::2], args[1::2])), False)
        return f(_picked(_aligned(call, target, grid).flat(), found))

    return body


for _n, _f in (("SUMIFS", sum), ("AVERAGEIFS", mean), ("MAXIFS", lambda xs: max(xs, default=0)), ("MINIFS", lambda xs: min(xs, default=0))):
    define(_n, 3, -1)(_ifs_family(_f))
