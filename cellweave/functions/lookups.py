"""Lookup and reference functions."""

from __future__ import annotations

import math

from ..formula.values import NA, REF, VALUE, Err, Failed, Refusal, compare, rank, to_bool
from .registry import MISSING, Area, Areas, Grid, define, grid_of, is_range
from .scalars import has_wildcard, wildcard


def _line(arg) -> list:
    grid = _table(arg)
    if grid.height != 1 and grid.width != 1:
        raise Failed(NA)
    return grid.flat()


def _table(arg) -> Grid:
    if isinstance(arg, Err):
        raise Failed(arg)
    if not is_range(arg):
        return Grid([[None if arg is MISSING else arg]])
    return grid_of(arg)


def exact(key, line: list, wild: bool = True, backwards: bool = False) -> int | None:
    """Index of the first (or last) equal value; a text key with wildcards is a pattern."""
    if wild and isinstance(key, str) and has_wildcard(key):
        pattern = wildcard(key)
        test = lambda v: isinstance(v, str) and bool(pattern.match(v))
    else:
        test = lambda v: not isinstance(v, Err) and compare(v, key) == 0
    order = range(len(line) - 1, -1, -1) if backwards else range(len(line))
    return next((i for i in order if test(line[i])), None)


def _sorted(line: list, down: bool, what: str) -> None:
    last = None
    for v in line:
        if v is None or isinstance(v, Err):
            continue
        if last is not None and (compare(last, v) > 0) != down and compare(last, v) != 0:
            raise Refusal("ARG_UNSUPPORTED", f"{what} by approximate match needs sorted data", what)
        last = v


def approximate(key, line: list, down: bool, what: str) -> int | None:
    """Of sorted values of the key's type the last that is not beyond the key."""
    _sorted(line, down, what)
    found = None
    for i, v in enumerate(line):
        if v is None or isinstance(v, Err) or rank(v) != rank(key):
            continue
        d = compare(v, key)
        if d == 0 or (d > 0) == down:
            found = i
        else:
            break
    return found


def _key(call, x):
    v = call.scalar(x)
    if isinstance(v, Err):
        raise Failed(v)
    return 0.0 if v is None else v


def _vh(vertical: bool):
    what = "VLOOKUP" if vertical else "HLOOKUP"

    def body(call, key, table, k, near=True):
        key, k = _key(call, key), math.trunc(call.number(k))
        if isinstance(table, Err):
            return table
        area = table if isinstance(table, Area) else None
        grid = None if area else _table(table)
        width = (area.width if vertical else area.height) if area else (grid.width if vertical else grid.height)
        if k < 1:
            raise Failed(VALUE)
        if k > width:
            raise Failed(REF)
        # an argument left out after its comma is blank, which is FALSE
        near = to_bool(None if near is MISSING else call.scalar(near))
        if area:  # only the line that is searched and one cell are read
            line = _first_line(area, vertical)
            at = None if near else _fast(key, line)
            if at is None:
                values = line.grid().flat()
                at = approximate(key, values, False, what) if near else exact(key, values)
            if at is None or at < 0:
                return NA
            row, col = (area.top + at, area.left + k - 1) if vertical else (area.top + k - 1, area.left + at)
            return area.book.read(area.sheet, row, col)
        line = [r[0] for r in grid.rows] if vertical else grid.rows[0] if grid.rows else []
        at = approximate(key, line, False, what) if near else exact(key, line)
        if at is None:
            return NA
        row, col = (at, k - 1) if vertical else (k - 1, at)
        return grid.rows[row][col] if row < grid.height and col < grid.width else None

    return body


def _first_line(area: Area, vertical: bool) -> Area:
    bottom, right = (area.bottom, area.left) if vertical else (area.top, area.right)
    return Area(area.book, area.sheet, area.top, area.left, bottom, right, bottom - area.top + 1, right - area.left + 1)


def _fast(key, line) -> int | None:
    """Offset of a number in a column of cells, -1 if it is not there; None where the general search must decide."""
    if isinstance(line, Area) and line.left == line.right and isinstance(key, float) and key != 0:
        return line.book.position(line, key)
    return None


define("VLOOKUP", 3, 4)(_vh(True))
define("HLOOKUP", 3, 4)(_vh(False))


@define("MATCH", 2, 3)
def _match(call, key, line, kind=1.0):
    key, area, kind = _key(call, key), line, 0 if kind is MISSING else call.number(kind)
    if kind == 0 and (at := _fast(key, area)) is not None:
        return NA if at < 0 else at + 1
    line = _line(area)
    at = exact(key, line) if kind == 0 else approximate(key, line, kind < 0, "MATCH")
    return NA if at is None else at + 1


@define("LOOKUP", 2, 3)
def _lookup(call, key, line, result=MISSING):
    key, grid = _key(call, key), _table(line)
    if result is not MISSING:
        search, out = _line(line), _line(result)
    elif grid.width >= grid.height:
        search, out = grid.rows[0], grid.rows[-1]
    else:
        search, out = [r[0] for r in grid.rows], [r[-1] for r in grid.rows]
    at = approximate(key, search, False, "LOOKUP")
    return NA if at is None else out[at] if at < len(out) else None


def _near(key, line: list, above: bool) -> int | None:
    """The nearest value of the key's type at or beyond it, wherever it stands."""
    best = None
    for i, v in enumerate(line):
        if v is None or isinstance(v, Err) or rank(v) != rank(key):
            continue
        d = compare(v, key)
        if d == 0:
            return i
        if (d > 0) == above and (best is None or (compare(v, line[best]) < 0) == above and compare(v, line[best]) != 0):
            best = i
    return best


def _find(call, key, line, match, search) -> int | None:
    match, backwards = math.trunc(call.number(match)), call.number(search) == -1
    if match in (-1, 1):
        return _near(key, line, match == 1)
    if match not in (0, 2):
        raise Failed(VALUE)
    return exact(key, line, match == 2, backwards)


@define("XMATCH", 2, 4)
def _xmatch(call, key, line, match=0.0, search=1.0):
    at = _find(call, _key(call, key), _line(line), match, search)
    return NA if at is None else at + 1


@define("XLOOKUP", 3, 6)
def _xlookup(call, key, line, result, fallback=MISSING, match=0.0, search=1.0):
    key, grid, out = _key(call, key), _table(line), _table(result)
    if grid.height != 1 and grid.width != 1:
        raise Failed(VALUE)
    at = _find(call, key, grid.flat(), match, search)
    if at is None:
        return NA if fallback is MISSING else call.scalar(fallback)
    if grid.width == 1 and not (grid.height == 1 and out.height == 1):
        return Grid([out.rows[at]]) if at < out.height else VALUE
    return Grid([[r[at]] for r in out.rows]) if at < out.width else VALUE


@define("INDEX", 2, 3)
def _index(call, table, row, col=MISSING):
    if isinstance(table, Err):
        return table
    if isinstance(table, Areas):
        return VALUE
    height, width = (table.height, table.width) if isinstance(table, Area) else ((g := _table(table)).height, g.width)
    r = 0 if row is MISSING else math.trunc(call.number(row))
    c = 0 if col is MISSING else math.trunc(call.number(col))
    if col is MISSING and height == 1 and width > 1:
        r, c = 1 if r else 0, r
    elif col is MISSING and width == 1:
        c = 1
    if r < 0 or c < 0:
        raise Failed(VALUE)
    if r > height or c > width:
        raise Failed(REF)
    if isinstance(table, Area):
        top, bottom = (table.top + r - 1,) * 2 if r else (table.top, table.bottom)
        left, right = (table.left + c - 1,) * 2 if c else (table.left, table.right)
        return Area(table.book, table.sheet, top, left, bottom, right, bottom - top + 1 if r else height, right - left + 1 if c else width)
    rows = [_table(table).rows[r - 1]] if r else _table(table).rows
    return Grid([[x[c - 1]] if c else x for x in rows])


@define("ROW", 0, 1)
def _row(call, x=MISSING):
    return call.row if x is MISSING else x.top if isinstance(x, Area) else x if isinstance(x, Err) else VALUE


@define("COLUMN", 0, 1)
def _column(call, x=MISSING):
    return call.col if x is MISSING else x.left if isinstance(x, Area) else x if isinstance(x, Err) else VALUE


define("ROWS", 1)(lambda call, x: x.height if isinstance(x, Area) else grid_of(x).height)
define("COLUMNS", 1)(lambda call, x: x.width if isinstance(x, Area) else grid_of(x).width)
define("AREAS", 1)(lambda call, x: 1 if isinstance(x, Area) else VALUE)
define("TRANSPOSE", 1)(lambda call, x: Grid(list(zip(*grid_of(x).rows))))
