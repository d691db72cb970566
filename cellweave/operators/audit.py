"""Numbers typed where a formula belongs: literals that contradict the formulas around them."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from ..formula.syntax import Ref, shape, translate, unparse, walk
from ..formula.values import address, agree
from .book import Book

#: References of more cells are not looked into.
MOST_CELLS = 256


@dataclass(frozen=True)
class Finding:
    sheet: int
    row: int
    col: int
    stated: float
    expected: float
    formula: str
    axis: str
    pattern: tuple[str, ...]

    def describe(self, book: Book) -> str:
        where = f"{book.sheets[self.sheet]}!{address(self.row, self.col)}"
        return f"{where} holds {self.stated:g}, but its {self.axis} ({', '.join(self.pattern)}) suggests ={self.formula}, which is {self.expected:g}"


def _band(members: list[int], at: int, typed: set[int]) -> bool:
    """Whether a literal belongs to a band: formulas fill half of their span or more, it stands among them or right after
    the last, never before, and between them are only formulas of the band and typed numbers."""
    low, high = min(members), max(members)
    if high - low + 1 > 2 * len(members) or not low <= at <= high + 1:
        return False
    return all(p == at or p in members or p in typed for p in range(low, high + 1))


def _reads(book: Book, sheet: int, tree) -> tuple[bool, bool]:
    """(reads a computed cell, reads any cell) over the small references within the sheet."""
    computed = present = False
    for node in walk(tree):
        if isinstance(node, Ref) and node.sheet is None and node.shape in ("cell", "range"):
            if (node.bottom - node.top + 1) * (node.right - node.left + 1) <= MOST_CELLS:
                for r in range(node.top, node.bottom + 1):
                    for c in range(node.left, node.right + 1):
                        if (record := book.cells.get((sheet, r, c))) is not None:
                            present = True
                            computed = computed or (sheet, r, c) in book._trees
    return computed, present


def find_hardcoded(book: Book, most: int | None = None) -> list[Finding]:
    """Findings of an evaluated workbook, rows before columns; each literal is reported once, ``most`` at most."""
    typed = {at for at, r in book.cells.items() if r.formula is None and isinstance(r.value, float)}
    # by line: shape of the formula -> positions on the line
    lines: dict[tuple, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
    numbers: dict[tuple, set[int]] = defaultdict(set)
    for s, r, c in book._trees:
        tree = book.tree(s, r, c)
        key = shape(tree, r, c)
        lines["row", s, r][key].append(c)
        lines["column", s, c][key].append(r)
    for s, r, c in typed:
        numbers["row", s, r].add(c)
        numbers["column", s, c].add(r)
    out: list[Finding] = []
    for s, r, c in sorted(typed):
        for axis, line, at in (("row", r, c), ("column", c, r)):
            found = _judge(book, (s, r, c), axis, at, lines.get((axis, s, line), {}), numbers[axis, s, line])
            if found:
                out.append(found)
                break
        if most is not None and len(out) == most:
            break
    return out


def _judge(book: Book, place, axis: str, at: int, shapes, typed: set[int]) -> Finding | None:
    s, r, c = place
    for members in shapes.values():
        members = sorted(members)
        if len(members) < 2 or not _band(members, at, typed):
            continue
        anchor = (s, r, members[0]) if axis == "row" else (s, members[0], c)
        tree = book.tree(*anchor)
        meant = translate(tree, r - anchor[1], c - anchor[2])
        if _reads(book, s, tree) != _reads(book, s, meant):
            continue  # another series, such as last year's figures, typed in as a whole
        expected, reason = book.try_evaluate(unparse(meant), s, r, c)
        stated = book.cells[place].value
        if reason is not None or not isinstance(expected, float) or agree(stated, expected):
            continue
        names = tuple(address(r, m) if axis == "row" else address(m, c) for m in members[:4])
        return Finding(s, r, c, stated, expected, unparse(meant), axis, names)
    return None
