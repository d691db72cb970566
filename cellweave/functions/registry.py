"""The function registry: names, arity, flags and bodies; and how bodies read their arguments.

An argument is a scalar, a Grid (rows of scalars), an Area (a live rectangle), Areas (a union) or MISSING. Bodies of lazy
functions get trees instead and evaluate what they need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..formula.values import VALUE, Err, Failed, Refusal, finite, to_bool, to_number, to_text


class _Missing:
    def __repr__(self) -> str:
        return "MISSING"


MISSING = _Missing()


class Grid:
    """A rectangle of values; short rows are padded with blanks."""

    def __init__(self, rows):
        rows = [list(r) for r in rows]
        width = max((len(r) for r in rows), default=0)
        self.rows = [r + [None] * (width - len(r)) for r in rows]
        self.height, self.width = len(rows), width

    def flat(self) -> list:
        return [v for r in self.rows for v in r]


@dataclass(frozen=True)
class Area:
    """Sheet number and rectangle, clamped to what is used; ``height`` and ``width`` are as declared."""

    book: object
    sheet: int
    top: int
    left: int
    bottom: int
    right: int
    height: int
    width: int

    def grid(self) -> Grid:
        return self.book.grid(self)


@dataclass(frozen=True)
class Areas:
    parts: tuple


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int  # -1: any number
    body: Callable
    lazy: bool = False
    volatile: bool = False
    arrays: bool = False
    refused: str | None = None


_registry: dict[str, Function] = {}


def define(names: str, least: int, most: int | None = None, **flags):
    """Registers a body under one or more names; a name can be registered once."""

    def add(body):
        for name in names.split():
            if name in _registry:
                raise ValueError(f"{name} is registered already")
            _registry[name] = Function(name, least, least if most is None else most, body, **flags)
        return body

    return add


def refuse(names: str, reason: str) -> None:
    for name in names.split():

        def body(call, *args, name=name):
            raise Refusal("FN_UNIMPLEMENTED", reason, name)

        define(name, 0, -1, lazy=True, refused=reason)(body)


def lookup(name: str) -> Function | None:
    return _registry.get(name)


def implemented() -> list[str]:
    return sorted(n for n, f in _registry.items() if f.refused is None)


def refused() -> dict[str, str]:
    return {n: f.refused for n, f in sorted(_registry.items()) if f.refused is not None}


# ---- reading arguments -------------------------------------------------------------------------------------------------


def is_range(arg) -> bool:
    return isinstance(arg, (Area, Grid, Areas))


def grid_of(arg) -> Grid:
    """Any argument as a rectangle; an error argument propagates."""
    if isinstance(arg, Area):
        return arg.grid()
    if isinstance(arg, Grid):
        return arg
    if isinstance(arg, Areas):
        raise Failed(VALUE)
    if isinstance(arg, Err):
        raise Failed(arg)
    return Grid([[None if arg is MISSING else arg]])


def values_of(arg) -> Iterator:
    """All values of an argument, row by row; a union's areas in turn."""
    if isinstance(arg, Areas):
        for part in arg.parts:
            yield from values_of(part)
    elif is_range(arg):
        yield from grid_of(arg).flat()
    else:
        yield None if arg is MISSING else arg


def numbers(args) -> list[float]:
    """Numbers of aggregates: in ranges only numbers are seen; direct arguments are coerced; the first error wins."""
    out: list[float] = []
    for arg in args:
        if isinstance(arg, Area) and (fast := arg.book.numbers(arg)) is not None:
            out += fast
        elif is_range(arg):
            for v in values_of(arg):
                if isinstance(v, Err):
                    raise Failed(v)
                if isinstance(v, float):
                    out.append(v)
        else:
            out.append(to_number(None if arg is MISSING else arg))
    return out


def numbers_a(args) -> list[float]:
    """As ``numbers``, but in ranges text counts as 0 and booleans as 1 and 0."""
    out: list[float] = []
    for arg in args:
        for v in values_of(arg):
            if isinstance(v, Err):
                raise Failed(v)
            if not is_range(arg):
                out.append(to_number(v))
            elif isinstance(v, (bool, float)):
                out.append(float(v))
            elif isinstance(v, str):
                out.append(0.0)
    return out


class Call:
    """What a body may ask of the evaluation it runs in."""

    def __init__(self, evaluator, row: int, col: int, sheet: int, arrays: bool = False, moved: int = 0):
        self.evaluator, self.row, self.col, self.sheet, self.arrays = evaluator, row, col, sheet, arrays
        self.moved = moved  # rows by which relative references lie below those of the tree
        self.volatile = False

    def value(self, tree):
        """Evaluates a lazy argument to whatever it is."""
        return self.evaluator.evaluate(tree, self)

    def scalar(self, arg):
        """One value: a range gives the cell in this row or column, a grid its first, a missing argument blank."""
        return self.evaluator.scalar(arg, self)

    def number(self, arg) -> float:
        return to_number(self.scalar(arg))

    def text(self, arg) -> str:
        return to_text(self.scalar(arg))

    def boolean(self, arg) -> bool:
        return to_bool(self.scalar(arg))

    def now(self) -> float:
        return self.evaluator.now


def checked(result):
    """A body's result as a value: ints and numbers become finite floats."""
    if isinstance(result, bool) or result is None or isinstance(result, (str, Err, Grid, Area, Areas)):
        return result
    return finite(result)
