"""Formulas over whole columns, running and sliding ranges, criteria of rows and lookups: table mode gives what cell mode gives."""

import math
import random

import pytest

from cellweave.formula.values import Err, Refusal
from cellweave.operators import ordered, table
from cellweave.operators.book import Book
from cellweave.operators.table import Sheet

TEXTS = ["north", "North", "n*", "?orth", "<>north", ">m", ">=2", "<5", "=2", "2", "", None, "a~*b", "a*b", "<>", "=", "TRUE", "x\ny", "🙂a", "a.c", "(b"]


def column(kind, rnd, n):
    if kind == "errors":  # what 1/A gives errors for
        return [rnd.choice([0.0, 1.0, 2.0, -4.0, None]) for _ in range(n)]
    if kind == "num":
        return [rnd.choice([0.0, 2.0, 2.0, 5.5, -1.0, 7.0, None]) for _ in range(n)]
    return [rnd.choice(TEXTS) for _ in range(n)]


def data(seed, n=15):
    rnd = random.Random(seed)
    rows = list(zip(range(1, n + 1), column("errors", rnd, n), column("num", rnd, n), column("text", rnd, n), column("num", rnd, n), [rnd.random() < 0.5 for _ in range(n)]))
    table_rows = [(i + 1, *r) for i, r in enumerate(zip([-3.0, 0.0, 2.0, 2.0, 5.5, 9.0], ["north", "A*B", "south", "North", None, "2"], [10.0, 20.0, None, 40.0, 50.0, 60.0], [7.0, None, 0.0, 2.0, 2.0, -1.0]))]
    return rows, table_rows


WHOLE = [
    "SUM(B:B)", "SUM(G:G)", "COUNT(G:G)", "COUNTA(G:G)", "COUNTBLANK(B:B)", "COUNTBLANK(C:C)", "COUNTA(C:C)", "AVERAGE(B:B)", "MAX(G:G)", "MIN(B:B)", "PRODUCT(B:B)", "SUMSQ(B:B)", "MEDIAN(B:B)", "STDEV(B:B)", "VAR.P(B:B)", "SUM(C:C)", "AVERAGE(C:C)", "AVERAGEA(C:C)", "AVERAGEA(F:F)", "MAXA(F:F)",
    "MINA(C:C)", "LARGE(B:B,2)", "SMALL(B:B,3)", "LARGE(B:B,99)", "LARGE(G:G,1)", "PERCENTILE(B:B,0.3)", "PERCENTILE.EXC(B:B,0.3)", "PERCENTILE.EXC(B:B,0.001)", "QUARTILE(B:B,3)", "QUARTILE.EXC(B:B,1)", "CORREL(B:B,E:E)", "RSQ(B:B,E:E)", "SLOPE(B:B,E:E)", "INTERCEPT(B:B,E:E)", "FORECAST(E1,B:B,E:E)", "CORREL(B:B,G:G)",
    "SUMPRODUCT(B:B,E:E)", 'SUMPRODUCT((B:B>1)*(C:C<>"north")*1)', "SUMPRODUCT(G:G)", "SUBTOTAL(9,B:B)", "SUBTOTAL(6,B:B)", "SUBTOTAL(3,G:G)", "SUBTOTAL(1,G:G)", "AND(F:F)", "OR(F:F)", "XOR(F:F)", "AND(C:C)", "B1/SUM(B:B)", "SUM(T!A:A)*2",
    "NPV(10%,B:B)", "NPV(0.07,E:E)", "NPV(-1,B:B)", "NPV(0.1,C:C)", "NPV(0.1,G:G)", "NPV(-150%,E:E)", "MIRR(B:B,10%,12%)", "MIRR(E:E,0.1,-0.2)", "MIRR(C:C,0.1,0.1)", "MIRR(A:A,0.1,0.1)", "MIRR(G:G,0.1,0.1)", "MIRR(E:E,-1,0.1)", "XNPV(0.1,A:A,A:A)", "XNPV(10%,B:B,A:A)", "XNPV(0.1,T!A:A,T!C:C)", "XNPV(0.1,A:A,E:E)", "XNPV(-1,A:A,A:A)", "XNPV(0.1,G:G,A:A)", "XNPV(0.1,C:C,A:A)",
]
ROUND = ["SUM($B$1:B1)", "SUM($G$1:G1)", "COUNT($G$1:G1)", "AVERAGE($B$1:B1)", "MAX($B$1:B1)", "MIN($E$1:E1)", "PRODUCT($B$1:B1)", "SUM(B1:B3)", "SUM(G1:G2)", "AVERAGE(B1:B2)", "B2-B1", "IFERROR(G2,-1)", "SUM($B$1:B1)-B1+MAX(E1:E4)", "RANK(A1,A:A)", "RANK(A1,A:A,1)"]
KEYED = [
    "COUNTIF(B:B,B1)", "COUNTIF(C:C,C1)", "COUNTIF(B:B,C1)", "COUNTIF(C:C,B1)", "COUNTIF(F:F,F1)", "COUNTIF(F:F,C1)", "COUNTIF(G:G,B1)", "COUNTIF(G:G,C1)", "COUNTIF(G:G,0)", 'COUNTIF(G:G,"<>2")', 'COUNTIF(G:G,"")', "SUMIF(C:C,C1,B:B)", "SUMIF(B:B,B1)", "SUMIF(E:E,E1,G:G)", "AVERAGEIF(E:E,E1,B:B)", "AVERAGEIF(C:C,C1,G:G)",
    "SUMIFS(B:B,C:C,C1,E:E,E1)", 'COUNTIFS(C:C,C1,E:E,">0")', "COUNTIFS(C:C,C1,B:B,C1)", "MAXIFS(B:B,C:C,C1)", "MINIFS(G:G,E:E,E1)", 'SUMIFS(G:G,B:B,">5")', 'COUNTIF(C:C,">="&B1)', 'SUMIF(B:B,"<="&E1,E:E)', 'COUNTIF(B:B,"<>"&E1)', "COUNTIF(T!A:A,B1)+SUMIF(T!B:B,C1,T!C:C)",
]
LOOKUPS = [
    "VLOOKUP(B1,T!A:C,3,FALSE)", "VLOOKUP(B1,T!A:B,2,)", "VLOOKUP(E1,T!A:C,3)", "VLOOKUP(C1,T!B:C,2,FALSE)", "IFERROR(VLOOKUP(C1,T!B:C,2,FALSE),-1)", "VLOOKUP(B1,T!A:B,3,FALSE)", "VLOOKUP(B1,T!A:B,0,FALSE)", "MATCH(B1,T!A:A,0)", "MATCH(E1,T!A:A)", "MATCH(E1,T!A:A,1)", "MATCH(C1,T!B:B,0)", "XMATCH(B1,T!A:A)", "XMATCH(E1,T!D:D,1)", "XMATCH(E1,T!D:D,-1)",
    "XMATCH(B1,T!A:A,0,-1)", "XLOOKUP(B1,T!A:A,T!C:C)", "XLOOKUP(B1,T!A:A,T!C:C,-5)", "XLOOKUP(E1,T!A:A,T!B:B,\"none\",-1)", "XLOOKUP(E1,T!A:A,T!C:C,0,1)", "XLOOKUP(C1,T!B:B,T!C:C,0,2)", "LOOKUP(E1,T!A:A,T!C:C)", "INDEX(T!C:C,MATCH(B1,T!A:A,0))", "INDEX(T!B:B,2)", "INDEX(T!C:C,A1)", "VLOOKUP(G1,T!A:C,3,FALSE)", "VLOOKUP(VLOOKUP(B1,T!A:D,4,FALSE),T!A:C,3,FALSE)",
]


def expected(rows, others, formula):
    book = Book()
    book.add_sheet("S")
    book.add_sheet("T")
    for r, values in enumerate(rows, 1):
        for c, v in enumerate(values, 1):
            if v is not None:
                book.set_value(0, r, c, float(v) if isinstance(v, int) and not isinstance(v, bool) else v)
        book.set_formula(0, r, 7, f"=1/B{r}")
    from cellweave.formula.syntax import parse, translate, unparse

    for r in range(1, len(rows) + 1):
        book.set_formula(0, r, 9, "=" + unparse(translate(parse(formula), r - 1, 0)))
    for r, values in enumerate(others, 1):
        for c, v in enumerate(values[1:], 1):
            if v is not None:
                book.set_value(1, r, c, v)
    book.evaluate_all()
    return [book.cells[0, r, 9] for r in range(1, len(rows) + 1)]


def sheets(spark, rows, others, parts=3):
    t = Sheet(spark.createDataFrame(others, "at int, a double, b string, c double, d double").repartition(2), {"A": "a", "B": "b", "C": "c", "D": "d"}, order=["at"])
    df = spark.createDataFrame([(r[0], float(r[0]), *r[1:]) for r in rows], "at int, k double, x double, b double, c string, e double, f boolean").repartition(parts)
    # as in cell mode: A the number of the row, B the column that 1/B fails on, G = 1/B
    s = Sheet(df, {"A": "k", "B": "x", "C": "c", "D": "b", "E": "e", "F": "f"}, order=["at"], others={"T": t})
    return s.add("G", "g", "=1/B1")


def laid_out(rows):
    """Rows as the book has them: A row, B errors' source, C text, D numbers, E numbers, F booleans."""
    return [(r[0], r[1], r[3], r[2], r[4], r[5]) for r in rows]


@pytest.mark.parametrize("seed,formulas", [(1, WHOLE), (2, ROUND), (3, KEYED), (4, KEYED), (5, LOOKUPS)], ids=["whole", "around", "keyed", "keyed2", "lookups"])
def test_table_mode_is_cell_mode(spark, seed, formulas, monkeypatch):
    monkeypatch.setattr(table, "WINDOW_ROWS", 5)  # so ranges cross blocks
    rows, others = data(seed)
    sheet, wrong = sheets(spark, rows, others), []
    for f in formulas:
        got = sheet.add("H", "h", "=" + f)
        error = got.errors.get("h")
        found = {r["at"]: (r["h"], r[error] if error else None) for r in got.df.select("at", "h", *([error] if error else [])).collect()}
        assert len(found) == len(rows), f
        for (at, *_), want in zip(rows, expected(laid_out(rows), others, f)):
            value, err = found[at]
            assert want.provenance == "computed", (f, want)
            w = want.value
            if isinstance(w, Err):
                same = err == w.kind
            else:
                value = ("" if isinstance(w, str) else 0.0 if isinstance(w, float) else False) if value is None else value
                same = err is None and (math.isclose(value, w, rel_tol=1e-9, abs_tol=1e-9) if isinstance(w, float) and isinstance(value, float) else value == w)
            if not same:
                wrong.append((f, at, rows[at - 1], w, value, err))
    assert not wrong, "\n".join(map(str, wrong[:25]))


def test_refused_rather_than_guessed(spark, monkeypatch):
    rows, others = data(6)
    sheet = sheets(spark, rows, others)
    for f in ("=VLOOKUP(E1,T!D:D,1)", "=MATCH(E1,T!C:C,-1)", "=VLOOKUP(C1,T!A:B,2,FALSE)", "=SUBTOTAL(109,B:B)", "=SUM(A:B)", "=COUNTIF(B:B,G1)", "=HLOOKUP(1,T!A:B,1)", "=TODAY()", "=SUM(Gone!A:A)", "=LARGE(B:B,E1)"):
        with pytest.raises(Refusal):
            sheet.add("H", "h", f)
    monkeypatch.setattr(table, "MOST_ODD", 2)
    with pytest.raises(Refusal, match="different criteria"):
        sheet.add("H", "h", '=COUNTIF(B:B,">"&A1)')
    assert [r.h for r in Sheet(sheet.df, sheet.columns, now=46228.5).add("H", "h", "=NOW()-TODAY()").df.select("h").distinct().collect()] == [0.5]


def test_within_groups(spark):
    rows = [(i, "ab"[i % 2], float(i * i % 7)) for i in range(12)]
    sheet = Sheet(spark.createDataFrame(rows, "k int, g string, x double"), {"A": "k", "B": "g", "C": "x"}, order=["k"], within=["g"])
    for f, of in (("LARGE(C:C,2)", lambda v: sorted(v)[-2]), ("SUM(C:C)", sum), ("MEDIAN(C:C)", lambda v: (sorted(v)[2] + sorted(v)[3]) / 2), ("COUNTA(C:C)", len), ("PERCENTILE(C:C,1)", max)):
        got = sheet.add("D", "d", "=" + f).df.collect()
        assert len(got) == 12 and all(r.d == pytest.approx(of([x for _, g, x in rows if g == r.g])) for r in got), f
    ranks = sheet.add("D", "d", "=RANK(C1,C:C)").df.collect()
    assert all(r.d == 1 + sum(g == r.g and x > r.x for _, g, x in rows) for r in ranks)


def test_no_window_runs_in_one_task(spark, monkeypatch):
    """Plans of running, sliding and neighbouring ranges hold no exchange of raw rows to a single partition."""
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 300)
    df = spark.range(2000).selectExpr("id as k", "cast(id as double) as x")
    sheet = Sheet(df, {"A": "k", "B": "x"}, order=["k"])
    for f in ("=SUM($B$1:B1)", "=AVERAGE(B1:B3)", "=B2-B1", "=RANK(B1,B:B)", "=LARGE(B:B,3)"):
        lines = sheet.add("C", "c", f).df._jdf.queryExecution().executedPlan().toString().split("\n")
        single = [i for i, x in enumerate(lines) if "SinglePartition" in x]
        # what does come together is sums of buckets or blocks, aggregated before
        assert all(any("HashAggregate" in y or "SortAggregate" in y or "ObjectHashAggregate" in y for y in lines[i + 1 : i + 3]) for i in single), f
