"""Table mode against cell mode, ordered operators against plain Python, and every registered query against DuckDB."""

import glob
import math
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.formula.syntax import Binary, Call, Lit, Percent, Ref, Template, Unary, parse, translate, unparse
from cellweave.formula.values import Err, Refusal, compare, number_text, parse_number
from cellweave.functions.columns import COMPILERS
from cellweave.functions.formats import format_number
from cellweave.functions.scalars import set_number_formatter
from cellweave.functions.library import implemented, refused
from cellweave.operators.book import Book
from cellweave.operators.ordered import approximate_lookup, exact_lookup, ranked, running, unsorted
from cellweave.operators.table import Sheet, matches, row_criterion
from cellweave.functions.aggregates import criterion
from cellweave.functions.columns import Typed

SF = "/root/testdata/sf0.001"

# ---- syntax

leaves = st.one_of(
    st.floats(0, 1e12, allow_nan=False).map(lambda x: Lit(float(f"{x:.10g}"))),
    st.text("ab\"' é", max_size=4).map(Lit),
    st.booleans().map(Lit),
    st.tuples(st.integers(1, 99), st.integers(1, 60), st.booleans(), st.booleans()).map(lambda t: Ref(None, t[0], t[1], t[0], t[1], (t[2], t[3], t[2], t[3]))),
)
trees = st.recursive(
    leaves,
    lambda x: st.one_of(
        st.tuples(st.sampled_from(["+", "-", "*", "/", "^", "&", "=", "<>", "<=", ">"]), x, x).map(lambda t: Binary(*t)),
        x.map(lambda t: Unary("-", t)),
        x.map(Percent),
        st.lists(x, min_size=1, max_size=3).map(lambda a: Call("SUM", tuple(a))),
    ),
    max_leaves=12,
)


@settings(max_examples=400, deadline=None)
@given(trees)
def test_parse_inverts_unparse(tree):
    assert parse(unparse(tree)) == tree


@settings(max_examples=300, deadline=None)
@given(trees, st.integers(0, 40), st.integers(1, 60))
def test_a_formula_filled_down_is_recognised(tree, down, row):
    text, moved = unparse(tree), translate(tree, down, 0)
    template = Template(text, row, parse(text))
    assert template.fits(text, row)
    if template.usable and template.fits(unparse(moved), row + down):
        assert parse(unparse(moved)) == translate(parse(text), down, 0)
    for other in (text + "+1", text.replace("A", "B")):
        assert other == text or not template.fits(other, row)


@settings(max_examples=300, deadline=None)
@given(st.floats(-1e18, 1e18, allow_nan=False))
def test_number_text_round_trips(x):
    assert math.isclose(parse_number(number_text(x)), x, rel_tol=1e-14, abs_tol=1e-300)


@settings(max_examples=300, deadline=None)
@given(*[st.one_of(st.none(), st.floats(-5, 5), st.text("aB", max_size=2), st.booleans())] * 3)
def test_comparison_is_an_order(a, b, c):
    assert compare(a, b) == -compare(b, a)
    if None not in (a, b, c) and compare(a, b) <= 0 and compare(b, c) <= 0:
        assert compare(a, c) <= 0


def test_capabilities():
    assert len(implemented()) == 204 and len(refused()) == 26 and not set(implemented()) & set(refused())
    assert set(COMPILERS) <= set(implemented())


def test_normal_distribution_to_the_tails(spark):
    """The compiled distribution against the library's complementary error function, and the inverse against the distribution."""
    at = [k / 8 for k in range(-296, 297)]
    near = [10.0**-k for k in range(1, 300, 7)] + [k / 200 for k in range(1, 200)] + [1 - 2.0**-k for k in range(2, 50, 3)]
    for z, below in Sheet(spark.createDataFrame([(x,) for x in at], "z double"), {"A": "z"}).add("B", "b", "=NORM.S.DIST(A1,TRUE)").df.select("z", "b").collect():
        assert math.isclose(below, math.erfc(-z / math.sqrt(2)) / 2, rel_tol=1e-12), z
    for p, z in Sheet(spark.createDataFrame([(x,) for x in near], "p double"), {"A": "p"}).add("B", "b", "=NORM.S.INV(A1)").df.select("p", "b").collect():
        assert math.isclose(math.erfc(-z / math.sqrt(2)) / 2, p, rel_tol=1e-11), p


# ---- typed mode gives what cell mode gives

FORMULAS = [
    "A1+B1*2", "A1/B1", "A1^2", "-A1^2", "A1&\"x\"", "C1&A1", "C1=UPPER(C1)", "A1>C1", "C1>A1", "D1+1", "D1>C1", "A1=B1", "A1<>0", "IF(A1>B1,A1,B1)", "IF(D1,1,2)", "IFERROR(A1/B1,-1)", "IFNA(A1/B1,-1)", "C1+1", "IFERROR(VALUE(C1),-9)",
    "ROUND(A1,1)", "ROUND(A1,-1)", "ROUNDUP(A1,0)", "ROUNDDOWN(A1,1)", "TRUNC(A1)", "INT(A1)", "MOD(A1,B1)", "MOD(A1,-3)", "QUOTIENT(A1,B1)", "EVEN(A1)", "ODD(A1)", "ABS(A1)", "SIGN(A1)", "SQRT(A1)", "LN(A1)", "LOG10(A1)", "LOG(A1,2)", "EXP(A1/100)", "MROUND(A1,0.25)", "CEILING(A1,0.5)",
    "FLOOR(A1,0.5)", "ATAN2(A1,B1)", "SIN(A1)", "DEGREES(A1)", "POWER(A1,0.5)", "LEN(C1)", "LEFT(C1,2)", "RIGHT(C1,2)", "RIGHT(C1,0)", "MID(C1,2,2)", "UPPER(C1)", "PROPER(C1)", "TRIM(C1)", "SUBSTITUTE(C1,\"a\",\"zz\")", "SUBSTITUTE(C1,\"a\",\"z\",2)", "REPLACE(C1,2,1,\"-\")", "REPT(C1,2)", "FIND(\"a\",C1)", "EXACT(C1,\"abc\")",
    "CONCATENATE(A1,C1,D1)", "AND(A1>0,D1)", "OR(A1>0,D1)", "XOR(A1>0,D1)", "NOT(D1)", "SWITCH(C1,\"ABC\",1,\"x\",2,3)", "SWITCH(B1,0,1,2,5)", "CHOOSE(B1+1,10,20)", "IFS(A1>5,1,A1>0,2)", "ISNUMBER(A1)", "ISTEXT(C1)", "ISBLANK(A1)", "ISERROR(A1/B1)", "ISNA(NA())", "ERROR.TYPE(A1/B1)", "N(D1)", "N(C1)", "T(C1)", "T(A1)", "TYPE(C1)",
    "ISEVEN(B1)", "ISODD(B1)", "SUM(A1,B1)", "MAX(A1,B1,3)", "AVERAGE(A1,B1)", "YEAR(E1)", "MONTH(E1)", "DAY(E1)", "WEEKDAY(E1)", "WEEKDAY(E1,2)", "WEEKDAY(E1,3)", "EDATE(E1,1)", "EOMONTH(E1,-1)", "DATE(YEAR(E1),MONTH(E1)+1,1)", "DAYS(E1,45000)", "DAYS360(E1,E1+45)", "DATEDIF(E1,E1+400,\"M\")", "DATEDIF(E1,E1+400,\"YM\")", "YEARFRAC(E1,E1+200)",
    "YEARFRAC(E1,E1+200,3)", "NETWORKDAYS(E1,E1+17)", "NETWORKDAYS(E1+9,E1)", "WORKDAY(E1,5)", "WORKDAY(E1,-7)", "WORKDAY(E1,0)", "PMT(B1/100,12,A1)", "FV(B1/100,12,A1)", "PV(B1/100,12,A1)", "IPMT(B1/100,3,12,A1)", "PPMT(B1/100,3,12,A1)", "NPER(B1/100,-50,A1)", "SLN(A1,1,B1)", "SYD(A1,1,5,2)", "DDB(ABS(A1)+5,1,5,2.5)", "EFFECT(B1/10,4)", "NOMINAL(B1/10,4)", "RRI(B1,A1,20)", "PDURATION(B1/100,A1,200)", "50%*A1",
    "CHAR(A1+64)", "CHAR(233)", "UNICHAR(B1+9731)", "UNICODE(C1)", "CODE(C1)", "SEARCH(\"?b\",C1)", "SEARCH(\"A\",C1,2)", "FIXED(A1*1000,1)", "FIXED(A1,0,TRUE)", "DOLLAR(A1*1000)", "TEXTJOIN(\"-\",TRUE,C1,\"\",B1)", "NUMBERVALUE(C1)", "NUMBERVALUE(\"1.234,5\",\",\",\".\")",
    "TEXT(A1,\"0.00\")", "TEXT(A1,\"#,##0.0\")", "TEXT(B1/8,\"0.0%\")", "TEXT(E1,\"yyyy-mm-dd\")", "TEXT(E1,\"mmm-yy\")", "TEXT(B1,\"0000\")", "TEXT(C1,\"0.0\")", "TIME(B1,B1*7,30)", "HOUR(E1+0.7)", "MINUTE(E1+0.7123)", "SECOND(E1+0.7123)", "DATEVALUE(\"2026-7-25\")", "DATEVALUE(C1)",
    "TIMEVALUE(\"13:45\")", "TIMEVALUE(C1)", "FACT(B1)", "FACT(A1)", "COMBIN(9,B1)", "COMBIN(B1,9)", "CEILING.MATH(A1)", "CEILING.MATH(A1,2,1)", "FLOOR.MATH(A1,0.5)", "FLOOR.MATH(A1,2,1)", "GCD(B1*12,18)", "LCM(B1,6)", "CUMIPMT(B1/100,12,1000,2,5,0)", "CUMPRINC(B1/100,12,1000,2,5,1)", "NPV(B1/100,A1,10,-5)",
    "NORM.S.DIST(A1,TRUE)", "NORM.S.DIST(A1,D1)", "NORM.S.DIST(-B1,FALSE)", "NORMSDIST(-A1)", "NORM.DIST(A1,B1,2,TRUE)", "NORM.DIST(A1,1,B1,FALSE)", "NORM.DIST(C1,1,2,TRUE)", "NORM.S.INV(B1/8)", "NORM.S.INV(A1)", "NORMSINV(B1/1000000)", "NORM.INV(B1/8,A1,2)", "NORM.INV(0.975,A1,B1)",
]
VALUES = [(12.5, 2.0, "abc", True, 45_123.0), (0.0, 0.0, "", False, 46_081.0), (-7.25, 3.0, "aab a", True, 45_351.0), (1.005, 5.0, " Ab  c ", False, 45_292.0), (2.675, 1.0, "12", None, 45_688.0), (None, 4.0, None, True, 45_199.0), (1e17, 7.0, "x-y z", False, 46_022.0), (0.1, -2.0, "5%", True, 45_657.0)]


def test_typed_mode_is_cell_mode(spark):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(VALUES)], "k int, a double, b double, c string, d boolean, e double")
    sheet = Sheet(df, dict(zip("ABCDE", "abcde")))
    compiled = {}
    for i, f in enumerate(FORMULAS):
        t = sheet.compile(f)
        compiled[f] = i
        df = df.withColumns({f"v{i}": t.value.cast("double") if t.kind == "num" else t.value, f"e{i}": t.error if t.error is not None else F.lit(None).cast("string")})
    wrong = []
    set_number_formatter(format_number)
    for row in df.collect():
        for f, i in compiled.items():
            book = Book()
            book.add_sheet("S")
            for col, v in enumerate(VALUES[row.k], 1):
                if v is not None:
                    book.set_value(0, 1, col, v)
            book.set_formula(0, 1, 9, f)
            book.evaluate_all()
            want = book.cells[0, 1, 9]
            assert want.provenance == "computed", (f, want)
            want, got, error = want.value, row[f"v{i}"], row[f"e{i}"]
            if isinstance(want, Err):
                same = error == want.kind
            else:
                got = ("" if isinstance(want, str) else 0.0 if isinstance(want, float) else False) if got is None else got
                same = error is None and (math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9) if isinstance(want, float) else got == want)
            if not same:
                wrong.append((f, VALUES[row.k], want, got, error))
    set_number_formatter(None)
    assert not wrong, wrong[:12]


def test_criteria_predicates(spark):
    data = [(0.0, "North"), (5.0, "northeast"), (None, ""), (-2.5, None), (7.0, "a*b"), (5.0, "15")]
    df = spark.createDataFrame(data, "x double, t string")
    num, text = Typed(F.col("x"), "num"), Typed(F.col("t"), "text")
    cases = [(num, 0, c) for c in (">1", "<=5", "<>5", "=5", "5", "<>", "", ">a", 5.0)] + [(text, 1, c) for c in ("north", "north*", "?orth", "<>north*", "*~**", "", "=", "<>", ">b", "=15")]
    got = df.agg(*[F.count_if(matches(h, c)).alias(f"c{i}") for i, (h, _, c) in enumerate(cases)]).first()
    for i, (_, k, c) in enumerate(cases):
        assert got[i] == sum(criterion(c)(r[k]) for r in data), c
    rows = spark.createDataFrame([(1.0, ">=1"), (1.0, "<>1"), (2.0, "2"), (None, "<>3"), (3.0, "<=2.5")], "x double, c string")
    assert [r[0] for r in rows.select(row_criterion(num, F.col("c"))).collect()] == [True, False, True, True, False]


def test_sheet_windows_and_keys(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i * i)) for i in range(1, 9)], "k int, g string, x double")
    s = Sheet(df, {"A": "k", "B": "g", "C": "x"}, order=["k"]).add("D", "run", "=SUM($C$1:C1)").add("E", "next3", "=SUM(C1:C3)").add("F", "share", "=C1/SUM(C:C)").add("G", "mine", "=SUMIFS(C:C,B:B,B1)").add("H", "both", '=COUNTIF(B:B,B1)+SUMIFS(C:C,B:B,"a")*0').add("I", "after", "=A2-A1")
    rows = s.df.orderBy("k").collect()
    xs = [float(i * i) for i in range(1, 9)]
    for i, r in enumerate(rows):
        assert r.run == sum(xs[: i + 1]) and r.next3 == sum(xs[i : i + 3]) and r.share == pytest.approx(xs[i] / sum(xs)) and r.mine == sum(xs[i % 2 :: 2]) and r.both == 4
    assert [r.after for r in rows][:-1] == [1.0] * 7
    for bad in ("=OFFSET(A1,1,1)", "=NOPE(1)", "=Z1", "=SUM(A1:B1)", "=IF(A1>0,1,\"x\")"):
        with pytest.raises(Refusal):
            s.compile(bad)


# ---- ordered operators


def test_running_and_rank(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(40), rnd.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(5)
    run = {r.id: r.total for r in running(df, F.col("k"), ["id"], {"total": F.col("v")}, 7).collect()}
    total = 0
    for i, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v
        assert run[i] == total
    place = {r.id: r.place for r in ranked(df, F.col("v"), "place", buckets=9).collect()}
    assert all(place[i] == 1 + sum(w > v for _, _, w in rows) for i, _, v in rows)


def test_lookups(spark):
    rnd = random.Random(2)
    table = [(p, rnd.choice([None, *range(0, 300, 7)]), f"n{p}") for p in range(80)]
    keys = [(i, float(rnd.randrange(-20, 330))) for i in range(300)]
    t, k = spark.createDataFrame(table, "pos int, lo int, name string"), spark.createDataFrame(keys, "id int, x double")
    for above in (False, True):
        got = {r.id: r.name for r in approximate_lookup(k, F.col("x"), t, "lo", ["name"], above, 5).collect()}
        for i, x in keys:
            near = [(lo, n) for _, lo, n in table if lo is not None and (lo >= x if above else lo <= x)]
            best = None if not near else (min if above else max)(near)[0]
            pool = [n for lo, n in near if lo == best]
            assert got[i] == (None if best is None else (min if above else max)(pool))
    names = spark.createDataFrame([(1, "Ab", 1), (2, "aB", 2), (3, None, 3), (4, "c", 4)], "pos int, key string, v int")
    rows = spark.createDataFrame([(1, "AB"), (2, "C"), (3, "zz"), (4, None)], "id int, k string")
    got = {r.id: (r.v, r._found, r._pos) for r in exact_lookup(rows, "k", names, "key", "pos", ["v"]).collect()}
    assert got == {1: (1, True, 1), 2: (4, True, 4), 3: (None, False, None), 4: (None, False, None)}
    assert unsorted(t.filter("lo is not null").orderBy("lo").selectExpr("row_number() over (order by lo) as pos", "lo"), "lo", "pos").first()[0] == 0
    assert unsorted(spark.createDataFrame([(1, 5), (2, 9), (3, 7), (4, None), (5, 10)], "pos int, lo int"), "lo", "pos").first()[0] == 1


# ---- registered queries


def tables():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


def names():
    from cellweave.plans.catalogue import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    from cellweave.plans.catalogue import ORACLE_SQL, QUERIES

    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in ORACLE_SQL:
        con = tables()
        want = con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(columns)
        found = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
        expected = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=str)
        assert len(found) == len(expected)
        for a, b in zip(found, expected):
            assert all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b)), (a, b)


def test_subtotals_of_many_orders(spark, tmp_path):
    from cellweave.plans.catalogue import QUERIES

    def values(rows):
        spark.createDataFrame(rows, "o_orderstatus string, o_totalprice double").write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
        return {(r.o_orderstatus, r.code): r.value for r in QUERIES["subtotal_codes"](spark, str(tmp_path)).collect()}

    got = values([("F", 9e9)] * 29 + [("O", 9e9)] * 400 + [("P", 250.25)] * 3)
    assert len(got) == 33 and got["F", 6] == 1e29 and got["O", 6] is None and got["P", 9] == 750.75  # 1e29 is beyond decimal(30,2), 1e400 #NUM!
    assert got["O", 9] == 3.6e12 and got["F", 4] == 9e9 and got["F", 2] == 29
    got = values([("F", 1e29), ("F", 1e29), ("F", None)])
    assert (got["F", 9], got["F", 4], got["F", 2]) == (2e29, 1e29, 2)


def test_subtotal_sums_cents_exactly(spark, tmp_path):
    from cellweave.plans.catalogue import QUERIES

    spark.range(0, 300_000, 1, 1).selectExpr("'F' AS o_orderstatus", "249999999.1D + id % 3 / 10D AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    want = sum(24999999910 + k % 3 * 10 for k in range(300_000)) / 100
    assert [r.value for r in QUERIES["subtotal_codes"](spark, str(tmp_path)).collect() if r.code == 9] == [want]
