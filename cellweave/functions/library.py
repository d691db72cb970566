"""All functions, registered; and those that are known and deliberately not evaluated."""

from __future__ import annotations

from . import aggregates, dates, finance, lookups, scalars  # noqa: F401
from .registry import implemented, lookup, refuse, refused  # noqa: F401

refuse("INDIRECT OFFSET", "references made while evaluating cannot be ordered beforehand")
refuse("AGGREGATE", "needs to know which rows are hidden")
refuse("CELL INFO ISFORMULA", "depends on the state of the workbook or its environment")
refuse("FILTER SORT SORTBY UNIQUE SEQUENCE RANDARRAY TOCOL TOROW", "its result spills over other cells")
refuse("MMULT MINVERSE MDETERM FREQUENCY TREND GROWTH LINEST LOGEST", "its result is an array that spills")
refuse("GETPIVOTDATA", "needs a pivot table's cache")
refuse("HYPERLINK", "is a link, not a value")
refuse("WEBSERVICE", "needs the network")
refuse("RTD", "needs a live feed")
