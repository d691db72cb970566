"""Values of cells and the two ways of not having one.

A scalar is a float, str, bool, Err or None (blank). An Err is a computed value. A Refusal is raised where an answer
would be a guess: it is not a value, and no function catches it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

#: The error kinds, in the order of ERROR.TYPE for the first seven.
KINDS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#SPILL!", "#CALC!")
MAX_ROWS, MAX_COLS = 1_048_576, 16_384


@dataclass(frozen=True)
class Err:
    kind: str

    def __repr__(self) -> str:
        return self.kind


NULL, DIV0, VALUE, REF, NAME, NUM, NA, SPILL, CALC = map(Err, KINDS)


class Refusal(Exception):
    """``code`` is one of SYNTAX, FN_UNKNOWN, FN_UNIMPLEMENTED, ARG_UNSUPPORTED, REF_SHAPE, FEATURE, LIMIT, INTERNAL."""

    def __init__(self, code: str, message: str, subject: str | None = None):
        super().__init__(message)
        self.code, self.message, self.subject = code, message, subject or code


class Failed(Exception):
    """Carries an Err out of a function's body; the call's value is then that Err."""

    def __init__(self, err: Err):
        super().__init__(err.kind)
        self.err = err


_NUMBER_TEXT = re.compile(r"[\s ]*([+-]?)\$?((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|\.\d+)(?:[eE]([+-]?\d+))?(%?)[\s ]*")


def parse_number(text: str) -> float | None:
    """The number a text spells: sign, $, thousands commas, decimals, exponent, a trailing %."""
    m = _NUMBER_TEXT.fullmatch(text)
    if not m:
        return None
    value = float(m[2].replace(",", "") + (f"e{m[3]}" if m[3] else ""))
    value = -value if m[1] == "-" else value
    return value / 100 if m[4] else value


def to_number(v) -> float:
    if isinstance(v, bool):
        return 1.0 if v else 0.0
    if isinstance(v, (int, float)):
        return float(v)
    if v is None:
        return 0.0
    if isinstance(v, Err):
        raise Failed(v)
    n = parse_number(v)
    if n is None:
        raise Failed(VALUE)
    return n


def number_text(x: float) -> str:
    """General format: 15 significant digits; scientific from exponent 16 on and from -15 down."""
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{x:.14e}".partition("e")
    exp = int(exponent)
    if -15 < exp < 16:
        text = f"{x:.{max(0, 14 - exp)}f}" if exp < 15 else str(int(float(f"{x:.14e}")))
        return text.rstrip("0").rstrip(".") if "." in text else text
    return f"{mantissa.rstrip('0').rstrip('.')}E{'+' if exp > 0 else '-'}{abs(exp)}"


def to_text(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if v is None:
        return ""
    if isinstance(v, Err):
        raise Failed(v)
    return v if isinstance(v, str) else number_text(float(v))


def to_bool(v) -> bool:
    if isinstance(v, bool):
        return v
    if v is None:
        return False
    if isinstance(v, Err):
        raise Failed(v)
    if isinstance(v, str):
        word = v.strip().upper()
        if word in ("TRUE", "FALSE"):
            return word == "TRUE"
        raise Failed(VALUE)
    return v != 0


def rank(v) -> int:
    return 2 if isinstance(v, bool) else 1 if isinstance(v, str) else 0


def compare(a, b) -> int:
    """-1, 0 or 1. Blank takes the other side's type; then numbers < text < booleans; text without regard to case."""
    for x in (a, b):
        if isinstance(x, Err):
            raise Failed(x)
    if a is None and b is None:
        return 0
    if a is None:
        a = False if isinstance(b, bool) else "" if isinstance(b, str) else 0.0
    if b is None:
        b = False if isinstance(a, bool) else "" if isinstance(a, str) else 0.0
    if rank(a) != rank(b):
        return -1 if rank(a) < rank(b) else 1
    if isinstance(a, str):
        a, b = a.upper().encode("utf-16-be", "surrogatepass"), b.upper().encode("utf-16-be", "surrogatepass")
    return (a > b) - (a < b)


def finite(x):
    """A function's numeric result: not-a-number, infinities and complex results are #NUM!."""
    if isinstance(x, complex):
        raise Failed(NUM)
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        x = float(x)
        if math.isnan(x) or math.isinf(x):
            raise Failed(NUM)
    return x


def agree(a, b) -> bool:
    """Whether a computed and a stored value are the same: numbers to 1e-9, relative beyond 1; blank and '' alike."""
    a, b = ("" if a is None else a), ("" if b is None else b)
    if rank(a) == rank(b) == 0 and not isinstance(a, Err) and not isinstance(b, Err):
        return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return type(a) is type(b) and a == b


def column_name(col: int) -> str:
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(name: str) -> int:
    n = 0
    for ch in name.upper():
        n = n * 26 + ord(ch) - 64
    return n


def address(row: int, col: int) -> str:
    return f"{column_name(col)}{row}"
