"""Spreadsheet formulas on Spark: the names that users need, imported when they are asked for."""

from importlib import import_module

_PUBLIC = {
    "parse": "formula.syntax", "unparse": "formula.syntax", "translate": "formula.syntax", "walk": "formula.syntax", "Refusal": "formula.values", "Err": "formula.values",
    "Sheet": "operators.table", "matches": "operators.table", "row_criterion": "operators.table", "Book": "operators.book",
    "evaluate_workbooks": "operators.cells", "evaluate_files": "operators.cells", "provenance_counts": "operators.cells", "gaps": "operators.cells", "hardcoded": "operators.cells",
    "function_uses": "operators.cells", "inspect_workbooks": "operators.cells", "precedents": "operators.cells", "find_hardcoded": "operators.audit",
    "running": "operators.ordered", "ranked": "operators.ordered", "numbered": "operators.ordered", "exact_lookup": "operators.ordered", "approximate_lookup": "operators.ordered", "unsorted": "operators.ordered",
    "define": "functions.registry", "refuse": "functions.registry", "implemented": "functions.registry", "refused": "functions.registry", "set_number_formatter": "functions.scalars",
    "cells": "sources.xlsx", "contents": "sources.xlsx", "workbooks": "sources.xlsx", "render": "sources.html", "evaluate_arrivals": "streaming.workbooks",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)
