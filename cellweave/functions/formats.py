"""A number formatter for TEXT: a documented set of codes; any other is refused rather than guessed.

Digits with optional grouping, decimals, percent, a leading $, two sections (positive;negative) with literal
parentheses; and dates made of yyyy yy mmmm mmm mm m dddd ddd dd d and separators.
"""

from __future__ import annotations

import re

from ..formula.values import Refusal, number_text
from .dates import parts, weekday
from .scalars import decimal_round

#: Month and day names of date codes.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

_NUMBER = re.compile(r"(\(?)(\$?)(#,##)?(0+|#)(?:\.(0+))?(%?)(\)?)")
_DATE = re.compile(r"(yyyy|yy|mmmm|mmm|mm|m|dddd|ddd|dd|d)|([-/ .,])")


def format_number(x: float, code: str) -> str:
    if code.lower() == "general":
        return number_text(x)
    sections = code.split(";")
    if len(sections) == 2:
        return _section(abs(x), sections[1], code) if x < 0 else _section(x, sections[0], code)
    if len(sections) > 2:
        raise Refusal("FEATURE", f"number format {code} is not supported", "TEXT")
    return _section(x, code, code)


def _section(x: float, section: str, code: str) -> str:
    m = _NUMBER.fullmatch(section)
    if m:
        lead, dollar, grouped, whole, decimals, percent, tail = m.groups()
        places = len(decimals or "")
        value = decimal_round(x * 100 if percent else x, places)
        digits = f"{abs(value):{',' if grouped else ''}.{places}f}"
        if whole == "#" and digits.split(".")[0] == "0":
            digits = digits[1:]
        head, _, rest = digits.partition(".")
        head = head.rjust(len(whole), "0") if not grouped else head
        return ("-" if value < 0 else "") + lead + dollar + head + ("." + rest if rest else "") + percent + tail
    if re.fullmatch(f"(?:{_DATE.pattern})+", section.lower()):
        return _date(x, section.lower())
    raise Refusal("FEATURE", f"number format {code} is not supported", "TEXT")


def _date(x: float, code: str) -> str:
    y, mo, d = parts(x)
    out = []
    for part, separator in _DATE.findall(code):
        if separator:
            out.append(separator)
        else:
            day = DAYS[weekday(int(x // 1))]
            out.append({"yyyy": f"{y:04}", "yy": f"{y % 100:02}", "mmmm": MONTHS[mo - 1], "mmm": MONTHS[mo - 1][:3], "mm": f"{mo:02}", "m": str(mo), "dddd": day, "ddd": day[:3], "dd": f"{d:02}", "d": str(d)}[part])
    return "".join(out)
