"""Group G: analysis of workbooks made from the tables, one workbook for each customer or part group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cells import evaluate_workbooks, function_uses, hardcoded
from .common import read

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _cell(row, col, number=None, formula=None):
    n = F.lit(None).cast("double") if number is None else number.cast("double")
    f = F.lit(None).cast("string") if formula is None else formula
    has = F.lit(number is not None and formula is not None)
    kind = F.lit("blank") if number is None else F.lit("num")
    return F.struct(F.lit(row).alias("row") if isinstance(row, int) else row.alias("row"), F.lit(col).alias("col"), kind.alias("kind"), n.alias("number"), f.alias("formula"), has.alias("has_cache"))


def _workbooks(df, name):
    """A long table of cells from rows of ``cells``, an array of cell structs."""
    null = F.lit(None)
    return df.select(name.alias("workbook_id"), F.explode("cells").alias("c")).select("workbook_id", F.lit(0).alias("sheet_index"), F.lit("S").alias("sheet"), "c.row", "c.col", "c.kind", "c.number", null.cast("string").alias("text"), null.cast("boolean").alias("bool"), null.cast("string").alias("err"), "c.formula", "c.has_cache")


@query("""
SELECT c_custkey, CAST(c_acctbal AS DOUBLE) + c_nationkey AS computed, (c_acctbal + c_nationkey) + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS cached, c_custkey % 10 = 0 AS stale FROM customer""")
def audit_stale_cache(spark, sf_dir):
    """Stored values that disagree with what their formula gives, beyond 1e-9; a workbook for each customer."""
    df = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    cached = F.col("a") + F.col("b") + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)
    books = df.select("c_custkey", F.array(_cell(1, 1, F.col("a")), _cell(1, 2, F.col("b")), _cell(1, 3, cached, F.lit("A1+B1"))).alias("cells"))
    overlay = evaluate_workbooks(_workbooks(books, F.col("c_custkey").cast("string"))).filter("col = 3")
    return overlay.select(F.col("workbook_id").cast("bigint").alias("c_custkey"), F.col("number").alias("computed"), "cached", "stale")



@query("""
SELECT 'w' || CAST(n_nationkey AS VARCHAR) AS workbook_id, 'E6' AS cell, 99.0::DOUBLE AS stated, CAST(n_nationkey + 20 AS DOUBLE) AS expected FROM nation WHERE n_nationkey % 2 = 0""")
def audit_hardcoded(spark, sf_dir):
    """A total typed in at the end of a row of totals, in every second workbook; the others hold a formula there."""
    n = F.col("n_nationkey")
    inputs = [_cell(4, c, n) for c in range(2, 6)] + [_cell(5, c, F.lit(20)) for c in range(2, 6)]
    totals = [_cell(6, c, None, F.lit(f"SUM({'ABCDE'[c - 1]}4:{'ABCDE'[c - 1]}5)")) for c in range(2, 5)]
    last = F.when(n % 2 == 0, _cell(6, 5, F.lit(99))).otherwise(_cell(6, 5, None, F.lit("SUM(E4:E5)")))
    df = read(spark, sf_dir, "nation").select("n_nationkey", F.array(*inputs, *totals, last).alias("cells"))
    return hardcoded(_workbooks(df, F.concat(F.lit("w"), n.cast("string")))).select("workbook_id", "cell", "stated", "expected")


@query("""
SELECT function, CAST(sum(uses) AS BIGINT) AS uses FROM (SELECT unnest(['SUM', 'IF', 'ROUND', 'OFFSET']) AS function, unnest([1, 1, 2, CASE WHEN p_size > 25 THEN 1 ELSE 0 END]) AS uses FROM part) WHERE uses > 0 GROUP BY function""")
def inspect_functions(spark, sf_dir):
    """Functions by use from parsing alone."""
    tail = F.when(F.col("p_size") > 25, "+OFFSET(A1,1,1)").otherwise("")
    formula = F.concat(F.lit("IF(SUM(A1:A9)>0,ROUND(A1,2),ROUND(B1,"), F.col("p_size").cast("string"), F.lit("))"), tail)
    cells = read(spark, sf_dir, "part").select(F.lit("w").alias("workbook_id"), F.lit(0).alias("sheet_index"), F.col("p_partkey").cast("int").alias("row"), F.lit(1).alias("col"), F.lit("blank").alias("kind"), formula.alias("formula"))
    return function_uses(cells).select("function", "uses")


@query("""
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS workbook_id, row, col, provenance, value, err FROM customer, LATERAL (VALUES
  (1, 1, 'literal', CAST(c_acctbal AS DOUBLE), CAST(NULL AS VARCHAR)), (2, 1, 'computed', c_acctbal * 2, NULL), (3, 1, 'computed', NULL, '#DIV/0!'), (4, 1, 'computed', -1.0, NULL),
  (5, 1, 'unsupported', NULL, NULL), (6, 1, 'unsupported', NULL, NULL), (7, 1, 'circular', NULL, NULL), (8, 1, 'circular', NULL, NULL), (9, 1, 'unsupported', NULL, NULL), (10, 1, 'volatile', 46228.0, NULL)) AS v(row, col, provenance, value, err)""")
def cell_eval_workbook(spark, sf_dir):
    """Whole workbooks: order, error values, refusals that spread, cycles, a frozen clock; one for each customer."""
    formulas = {2: "A1*2", 3: "A2/0", 4: "IFERROR(A3,-1)", 5: 'INDIRECT("A1")', 6: "SUM(A1,A5)", 7: "A8+1", 8: "A7+1", 9: "A8*2", 10: "TODAY()"}
    df = read(spark, sf_dir, "customer").select("c_custkey", F.array(_cell(1, 1, F.col("c_acctbal")), *[_cell(r, 1, None, F.lit(f)) for r, f in formulas.items()]).alias("cells"))
    overlay = evaluate_workbooks(_workbooks(df, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))), now=46228.5)
    return overlay.select("workbook_id", "row", "col", "provenance", F.col("number").alias("value"), "err")


#: formula -> SQL over a, where A1:A3 hold a, a + 10 and 2a, and B1:B3 hold 1, 2 and 3; a formula in row r stands in column D.
_CELLS = [
    ("ROW()", "1"), ("COLUMN()", "4"), ("ROWS(A1:A3)", "3"), ("COLUMNS(A1:C1)", "3"), ("AREAS(A1:A2)", "1"), ("SUM(TRANSPOSE(A1:A3))", "4 * a + 10"), ("HLOOKUP(2,{1,2,3;10,20,30},2,FALSE)", "20"), ("LOOKUP(2.5,B1:B3,A1:A3)", "a + 10"), ("VLOOKUP(3,{1,10;3,30},2,FALSE)", "30"), ("MATCH(2,B1:B3,0)", "2"),
    ("XMATCH(2.5,B1:B3,-1)", "2"), ("XLOOKUP(9,B1:B3,A1:A3,-7)", "-7"), ("INDEX(A1:B3,2,2)", "2"), ("SUM((A1:A2,A2:A3))", "5 * a + 20"), ("SUM(A1:B2 B1:B3)", "3"), ("SUM({1,2;3,4})", "10"), ("SUMPRODUCT(A1:A3,B1:B3)", "9 * a + 20"), ("SUMPRODUCT((B1:B3>1)*A1:A3)", "3 * a + 10"), ("RANK(2,B1:B3)", "2"), ("RANK.EQ(3,B1:B3,1)", "3"),
    ("SUBTOTAL(9,A1:A3)", "4 * a + 10"), ("IF(ISREF(A1),1,0)", "1"), ("COUNT(A1:B5)", "6"), ("COUNTA(A1:B5)", "6"), ("COUNTBLANK(A1:A5)", "2"), ("LARGE(B1:B3,1)", "3"), ("SMALL(B1:B3,1)", "1"), ("PERCENTILE(B1:B3,0.25)", "1.5"), ("PERCENTILE.INC(B1:B3,0.5)", "2"), ("PERCENTILE.EXC(B1:B3,0.5)", "2"), ("QUARTILE(B1:B3,1)", "1.5"),
    ("QUARTILE.INC(B1:B3,3)", "2.5"), ("QUARTILE.EXC(B1:B3,1)", "1"), ("CORREL(B1:B3,B1:B3)", "1"), ("RSQ(B1:B3,{2;4;6})", "1"), ("SLOPE({2;4;6},B1:B3)", "2"), ("INTERCEPT({3;5;7},B1:B3)", "1"), ("FORECAST(10,{3;5;7},B1:B3)", "21"), ("FORECAST.LINEAR(10,{3;5;7},B1:B3)", "21"), ("AVERAGEA(B1:B3)", "2"), ("MAXA(B1:B3)", "3"),
    ("MINA(B1:B3)", "1"), ("VAR(B1:B3)", "1"), ("VARP(B1:B3)", "2.0 / 3"), ("STDEV.S(B1:B3)", "1"), ("STDEVP(B1:B3)", "sqrt(2.0 / 3)"), ("NPV(0.1,B1:B3)", "1 / 1.1 + 2 / 1.21 + 3 / 1.331"), ("XNPV(0.1,{-100,110},{0,365})", "0"), ("MIRR({-100,60,60},0.1,0.12)", "sqrt((60 * 1.12 + 60) / 100) - 1"), ("IRR({-100,60,60})", "(60 + sqrt(3600 + 24000)) / 200 - 1"),
    ("XIRR({-100,110},{0,365})", "0.1"), ("RATE(1,0,-100,110)", "0.1"), ("RATE(2,0,-100,121)", "0.1"), ("NORM.S.DIST(0,TRUE)", "0.5"), ("NORM.S.DIST(0,FALSE)", "1 / sqrt(2 * pi())"), ("NORMSDIST(0)+NORMSDIST(2)+NORMSDIST(-2)", "1.5"), ("NORM.DIST(A1,A1,2,TRUE)", "0.5"), ("NORM.DIST(A1+2,A1,2,FALSE)", "exp(-0.5) / sqrt(8 * pi())"), ("NORM.S.INV(0.975)", "1.959963984540054"), ("NORMSINV(0.5)", "0"),
    ("NORM.INV(0.5,A1,2)", "a"), ("RANDBETWEEN(5,5)+INT(RAND())", "5"), ("NOW()", "46228.5"), ("@B1:B3+ROW()*0", None), ("SUMIF(B1:B3,\">1\",A1:A3)", "3 * a + 10"), ("IFERROR(MATCH(99,B1:B3,0),-1)", "-1"), ("ISNA(MATCH(99,B1:B3,0))*1", "1"), ("TYPE({1,2})", None), ("DB1", None),
]
_CELLS = [(f, sql) for f, sql in _CELLS if sql is not None]


@query(f"""
SELECT CAST(c_custkey AS VARCHAR) AS workbook_id, k, CAST(CAST(value AS DECIMAL(30,6)) AS DOUBLE) AS value FROM (SELECT c_custkey, c_acctbal AS a FROM customer),
LATERAL (VALUES {", ".join(f"({k}, CAST({str(k) if f == 'ROW()' else sql} AS DOUBLE))" for k, (f, sql) in enumerate(_CELLS, 1))}) AS v(k, value)""")
def cell_functions(spark, sf_dir):
    """Functions over ranges, arrays, unions and crossings within workbooks; a workbook for each customer."""
    a = F.col("a")
    fixed = [_cell(1, 1, a), _cell(2, 1, a + 10), _cell(3, 1, a * 2), *[_cell(r, 2, F.lit(r)) for r in (1, 2, 3)]]
    formulas = [_cell(k, 4, None, F.lit(f)) for k, (f, _) in enumerate(_CELLS, 1)]
    df = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("a")).select("c_custkey", F.array(*fixed, *formulas).alias("cells"))
    overlay = evaluate_workbooks(_workbooks(df, F.col("c_custkey").cast("string")), now=46228.5).filter("col = 4")
    return overlay.select("workbook_id", F.col("row").alias("k"), F.col("number").cast("decimal(30,6)").cast("double").alias("value"))
