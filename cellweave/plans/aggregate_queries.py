"""Groups B and C: aggregates and conditional aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import Typed
from ..operators.table import Sheet, matches
from .common import filled, money, r6, read

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT o_orderpriority, CAST(sum(p) AS DOUBLE) AS total, count(p) AS n, count(*) AS n_all, count(*) FILTER (p IS NULL) AS n_blank, CAST(CAST(avg(CAST(p AS DOUBLE)) AS DECIMAL(30,4)) AS DOUBLE) AS mean, CAST(min(p) AS DOUBLE) AS low, CAST(max(p) AS DOUBLE) AS high
FROM (SELECT o_orderpriority, CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS p FROM orders) GROUP BY o_orderpriority""")
def agg_basic(spark, sf_dir):
    """SUM, COUNT, COUNTA, COUNTBLANK, AVERAGE, MIN, MAX of each group; blanks are not counted."""
    df = read(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_custkey") % 10 != 0, F.col("o_totalprice")).alias("p"))
    got = Sheet(df, {"B": "p"}, within=["o_orderpriority"]).summary({"total": "=SUM(B:B)", "n": "=COUNT(B:B)", "n_all": "=COUNTA(B:B)+COUNTBLANK(B:B)", "n_blank": "=COUNTBLANK(B:B)", "mean": "=AVERAGE(B:B)", "low": "=MIN(B:B)", "high": "=MAX(B:B)"})
    whole = [F.col(c).cast("bigint").alias(c) for c in ("n", "n_all", "n_blank")]
    return got.select("o_orderpriority", F.col("total").cast("decimal(18,2)").cast("double").alias("total"), *whole, _r4(F.col("mean")).alias("mean"), "low", "high")



def _r4(x):
    return x.cast("decimal(30,4)").cast("double")


@query("""
SELECT p_brand, CAST(CAST(stddev_samp(p_retailprice) AS DECIMAL(30,4)) AS DOUBLE) AS sd, CAST(CAST(stddev_pop(p_retailprice) AS DECIMAL(30,4)) AS DOUBLE) AS sdp, CAST(CAST(var_samp(p_retailprice) AS DECIMAL(30,4)) AS DOUBLE) AS v,
       CAST(CAST(var_pop(p_retailprice) AS DECIMAL(30,4)) AS DOUBLE) AS vp, CAST(CAST(median(p_retailprice) AS DECIMAL(30,4)) AS DOUBLE) AS mid FROM part GROUP BY p_brand""")
def agg_spread(spark, sf_dir):
    """STDEV, STDEV.P, VAR, VAR.P and MEDIAN of each group."""
    names = {"sd": "=STDEV(B:B)", "sdp": "=STDEV.P(B:B)", "v": "=VAR.S(B:B)", "vp": "=VAR.P(B:B)", "mid": "=MEDIAN(B:B)"}
    df = Sheet(read(spark, sf_dir, "part").select("p_brand", "p_retailprice"), {"B": "p_retailprice"}, within=["p_brand"]).summary(names)
    return df.select("p_brand", *[_r4(F.col(n)).alias(n) for n in names])



@query("""
WITH x AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
e AS (SELECT o_orderpriority, max(CASE WHEN k = floor(0.9 * (n + 1)) THEN v END) AS a, max(CASE WHEN k = floor(0.9 * (n + 1)) + 1 THEN v END) AS b, max(0.9 * (n + 1) - floor(0.9 * (n + 1))) AS f FROM x GROUP BY o_orderpriority),
i AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.9) AS p90, quantile_cont(o_totalprice, 0.25) AS q1 FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, CAST(CAST(p90 AS DECIMAL(30,4)) AS DOUBLE) AS p90, CAST(CAST(q1 AS DECIMAL(30,4)) AS DOUBLE) AS q1, CAST(CAST(a + f * (b - a) AS DECIMAL(30,4)) AS DOUBLE) AS p90_exc FROM i JOIN e USING (o_orderpriority)""")
def agg_percentile(spark, sf_dir):
    """PERCENTILE, QUARTILE and PERCENTILE.EXC by the places of values in buckets: no group is held or ranked in one task."""
    names = {"p90": "=PERCENTILE(B:B,0.9)", "q1": "=QUARTILE(B:B,1)", "p90_exc": "=PERCENTILE.EXC(B:B,0.9)"}
    df = Sheet(read(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), {"B": "o_totalprice"}, within=["o_orderpriority"]).summary(names)
    return df.select("o_orderpriority", *[_r4(F.col(n)).alias(n) for n in names])



@query("""
SELECT l_orderkey, CAST(CAST(product(1 - l_discount) AS DECIMAL(30,6)) AS DOUBLE) AS kept, CAST(CAST(sum(l_quantity * l_quantity) AS DECIMAL(30,2)) AS DOUBLE) AS squares FROM lineitem GROUP BY l_orderkey""")
def agg_product_sumsq(spark, sf_dir):
    sheet = Sheet(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_quantity"), {"A": "l_discount", "B": "l_quantity"}, within=["l_orderkey"]).add("C", "rest", "=1-A1")
    df = sheet.summary({"kept": "=PRODUCT(C:C)", "squares": "=SUMSQ(B:B)"})
    return df.select("l_orderkey", r6("kept").alias("kept"), F.col("squares").cast("decimal(30,2)").cast("double").alias("squares"))



@query("""
SELECT l_returnflag, CAST(CAST(regr_slope(l_extendedprice, l_quantity) AS DECIMAL(30,4)) AS DOUBLE) AS slope, CAST(CAST(regr_intercept(l_extendedprice, l_quantity) AS DECIMAL(30,3)) AS DOUBLE) AS cut,
       CAST(CAST(regr_r2(l_extendedprice, l_quantity) AS DECIMAL(30,6)) AS DOUBLE) AS rsq, CAST(CAST(corr(l_extendedprice, l_quantity) AS DECIMAL(30,6)) AS DOUBLE) AS r,
       CAST(CAST(avg(l_extendedprice) + regr_slope(l_extendedprice, l_quantity) * (30 - avg(l_quantity)) AS DECIMAL(30,3)) AS DOUBLE) AS forecast30 FROM lineitem GROUP BY l_returnflag""")
def agg_regression(spark, sf_dir):
    """SLOPE, INTERCEPT, RSQ, CORREL and FORECAST, all from one aggregation."""
    sheet = Sheet(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity"), {"A": "l_extendedprice", "B": "l_quantity"}, within=["l_returnflag"])
    df = sheet.summary({"slope": "=SLOPE(A:A,B:B)", "cut": "=INTERCEPT(A:A,B:B)", "rsq": "=RSQ(A:A,B:B)", "r": "=CORREL(A:A,B:B)", "forecast30": "=FORECAST(30,A:A,B:B)"})
    three = lambda c: F.col(c).cast("decimal(30,3)").cast("double").alias(c)
    return df.select("l_returnflag", _r4(F.col("slope")).alias("slope"), three("cut"), r6("rsq").alias("rsq"), r6("r").alias("r"), three("forecast30"))



#: SUBTOTAL's codes in SQL; the product is that of 1 + x / 1e9, which stays finite.
_CODES = {1: "avg(x)", 2: "count(x)", 3: "count(x)", 4: "max(x)", 5: "min(x)", 6: "product(1 + x / 1e9)", 7: "stddev_samp(x)", 8: "stddev_pop(x)", 9: "sum(CAST(x AS DECIMAL(18,2)))", 10: "var_samp(x)", 11: "var_pop(x)"}


@query("SELECT o_orderstatus, code, CAST(CAST(value AS DECIMAL(30,2)) AS DOUBLE) AS value FROM (" + " UNION ALL ".join(f"SELECT o_orderstatus, {k} AS code, CAST({sql} AS DOUBLE) AS value FROM (SELECT o_orderstatus, o_totalprice AS x FROM orders) GROUP BY o_orderstatus" for k, sql in _CODES.items()) + ")")
def subtotal_codes(spark, sf_dir):
    """SUBTOTAL's codes, all from one aggregation. The sum is that of whole cents, exact up to 2^53 of them. Beyond decimal(30,2) a value has
    no decimals to lose and stays as it is; a product beyond the doubles is #NUM!, a null here. There the SQL ends in an error."""
    orders = read(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", F.round(F.col("o_totalprice") * 100).alias("cents"))
    sheet = Sheet(orders, {"A": "o_totalprice", "C": "cents"}, within=["o_orderstatus"]).add("B", "factor", "=1+A1/1E9")
    df = sheet.summary({f"c{k}": {6: "=SUBTOTAL(6,B:B)", 9: "=SUBTOTAL(9,C:C)/100"}.get(k, f"=SUBTOTAL({k},A:A)") for k in _CODES})
    long = df.select("o_orderstatus", F.explode(F.array(*[F.struct(F.lit(k).alias("code"), F.col(f"c{k}").alias("value")) for k in _CODES])).alias("x"))
    value = F.col("x.value")
    return long.select("o_orderstatus", "x.code", F.coalesce(value.try_cast("decimal(30,2)").cast("double"), value).alias("value"))


@query("""
SELECT l_returnflag, CAST(sum(CAST(round(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS DOUBLE) AS net, CAST(sum(CASE WHEN l_linestatus = 'O' AND l_quantity > 25 THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS open_large FROM lineitem GROUP BY l_returnflag""")
def sumproduct_weighted(spark, sf_dir):
    """SUMPRODUCT of products and of conditions."""
    sheet = Sheet(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_discount", "l_linestatus", "l_quantity"), {"A": "l_extendedprice", "B": "l_discount", "C": "l_linestatus", "D": "l_quantity"}, within=["l_returnflag"])
    df = sheet.summary({"net": "=SUMPRODUCT(ROUND(A:A*(1-B:B),2))", "open_large": '=SUMPRODUCT((C:C="o")*(D:D>25),D:D)'})
    return df.select("l_returnflag", *[F.col(c).cast("decimal(18,2)").cast("double").alias(c) for c in ("net", "open_large")])



@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def distinct_idiom(spark, sf_dir):
    """SUMPRODUCT(1/COUNTIF(r,r)) is a distinct count."""
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"))


@query("SELECT l_orderkey, bool_and(l_quantity > 5) AS all_large, bool_or(l_returnflag = 'R') AS any_returned, count(*) FILTER (l_tax > 0.04) % 2 = 1 AS odd_taxed FROM lineitem GROUP BY l_orderkey")
def bool_fold(spark, sf_dir):
    """AND, OR and XOR of whole columns of booleans."""
    sheet = Sheet(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_tax"), {"A": "l_quantity", "B": "l_returnflag", "C": "l_tax"}, within=["l_orderkey"])
    sheet = sheet.add("D", "large", "=A1>5").add("E", "back", '=B1="R"').add("F", "taxed", "=C1>0.04")
    return sheet.summary({"all_large": "=AND(D:D)", "any_returned": "=OR(E:E)", "odd_taxed": "=XOR(F:F)"}).select("l_orderkey", "all_large", "any_returned", "odd_taxed")



@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_nationkey) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def textjoin_ordered(spark, sf_dir):
    """TEXTJOIN keeps the order of rows."""
    df = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ordered = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    return df.groupBy("r_name").agg(F.array_join(F.transform(ordered, lambda x: x["n_name"]), ", ").alias("nations"))


_CRITERIA = {">25": "p_size > 25", "<=10": "p_size <= 10", "<>7": "p_size <> 7", "=7": "p_size = 7", "30": "p_size = 30"}
_PATTERNS = {"*a*": "upper(p_name) LIKE '%A%'", "?????*": "length(p_name) >= 5", "<>*e": "NOT upper(p_name) LIKE '%E'", "*~**": "p_name LIKE '%*%'"}


@query(" UNION ALL ".join([f"SELECT '{c}' AS criterion, count(*) FILTER ({sql}) AS n FROM part" for c, sql in (_CRITERIA | _PATTERNS).items()]))
def countif_criteria(spark, sf_dir):
    """The criteria language: comparisons, wildcards, negation; all counted in one pass."""
    df = read(spark, sf_dir, "part")
    size, name = Typed(F.col("p_size").cast("double"), "num"), Typed(F.col("p_name"), "text")
    held = {**{c: size for c in _CRITERIA}, **{c: name for c in _PATTERNS}}
    one = df.agg(*[F.count_if(matches(h, c)).alias(f"c{i}") for i, (c, h) in enumerate(held.items())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"c{i}").alias("n")) for i, c in enumerate(held)])).alias("x")).select("x.*")


@query("SELECT c_custkey, CAST(CAST(coalesce((SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders WHERE o_custkey = c_custkey), 0) AS DECIMAL(18,2)) AS DOUBLE) AS ordered FROM customer")
def sumif_keyed(spark, sf_dir):
    """SUMIF(orders key, this row's key, amounts): one aggregation by key and a left join; 0 where nothing meets it."""
    orders = Sheet(read(spark, sf_dir, "orders"), {"A": "o_custkey", "B": "o_totalprice"})
    sheet = Sheet(read(spark, sf_dir, "customer"), {"A": "c_custkey"}, others={"Orders": orders}).add("B", "ordered", "=SUMIF(Orders!A:A,A1,Orders!B:B)")
    return sheet.df.select("c_custkey", F.col("ordered").cast("decimal(18,2)").cast("double").alias("ordered"))


@query("""
SELECT r_name, c_mktsegment, CAST(sum(CAST(round(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS DOUBLE) AS net
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment""")
def sumifs_matrix(spark, sf_dir):
    """SUMIFS(net, region, $A, segment, B$): the whole grid is one aggregation by both keys."""
    lines = filled(read(spark, sf_dir, "lineitem"), {"A": "l_extendedprice", "B": "l_discount"}, {"net": ("C", "=ROUND(A1*(1-B1),2)")}, ["l_orderkey"])
    df = (
        lines.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return df.groupBy("r_name", "c_mktsegment").agg(F.sum(money("net")).cast("double").alias("net"))


@query("""
SELECT c_custkey, CAST(CAST(avg(o_totalprice) FILTER (o_orderstatus = 'P') AS DECIMAL(30,4)) AS DOUBLE) AS mean, CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN '#DIV/0!' END AS mean_error
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def averageifs_div0(spark, sf_dir):
    """AVERAGEIFS of nothing is #DIV/0!, a value."""
    orders = Sheet(read(spark, sf_dir, "orders"), {"A": "o_custkey", "B": "o_totalprice", "C": "o_orderstatus"})
    sheet = Sheet(read(spark, sf_dir, "customer"), {"A": "c_custkey"}, others={"Orders": orders}).add("B", "mean", '=AVERAGEIFS(Orders!B:B,Orders!A:A,A1,Orders!C:C,"p")')
    return sheet.df.select("c_custkey", _r4(F.col("mean")).alias("mean"), "mean_error")


@query("""
SELECT c_custkey, coalesce(max(o_totalprice) FILTER (o_totalprice > 300000), 0) AS high, coalesce(min(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS low FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def maxifs_minifs_zero(spark, sf_dir):
    """MAXIFS and MINIFS of nothing are 0."""
    orders = Sheet(read(spark, sf_dir, "orders"), {"A": "o_custkey", "B": "o_totalprice", "C": "o_orderstatus"})
    sheet = Sheet(read(spark, sf_dir, "customer"), {"A": "c_custkey"}, others={"O": orders}).add("B", "high", '=MAXIFS(O!B:B,O!A:A,A1,O!B:B,">300000")').add("C", "low", '=MINIFS(O!B:B,O!A:A,A1,O!C:C,"F")')
    return sheet.df.select("c_custkey", "high", "low")


@query("""
WITH c AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN '>=' WHEN 1 THEN '<' WHEN 2 THEN '=' ELSE '<>' END AS op, p_size AS x FROM part)
SELECT op || CAST(x AS VARCHAR) AS criterion, (SELECT count(*) FROM part q WHERE CASE op WHEN '>=' THEN q.p_size >= x WHEN '<' THEN q.p_size < x WHEN '=' THEN q.p_size = x ELSE q.p_size <> x END) AS n FROM c""")
def criteria_rowwise(spark, sf_dir):
    """COUNTIF(sizes, this row's criterion text): criteria meet the different values, not rows."""
    part = read(spark, sf_dir, "part").select("p_size")
    size = F.col("p_size")
    criteria = part.select(F.concat(F.when(size % 4 == 0, ">=").when(size % 4 == 1, "<").when(size % 4 == 2, "=").otherwise("<>"), size.cast("string")).alias("criterion")).distinct()
    sheet = Sheet(criteria, {"A": "criterion"}, others={"Part": Sheet(part, {"A": "p_size"})}).add("B", "n", "=COUNTIF(Part!A:A,A1)")
    return sheet.df.select("criterion", F.col("n").cast("bigint").alias("n"))


@query("""
WITH v AS (SELECT c_custkey, c_mktsegment, c_acctbal, CASE WHEN c_nationkey > 0 THEN c_acctbal / c_nationkey END AS q, c_nationkey = 0 AS bad FROM customer)
SELECT c_mktsegment, count(q) AS n, CASE WHEN count(*) FILTER (bad) = 0 THEN CAST(CAST(sum(q) AS DECIMAL(30,2)) AS DOUBLE) END AS total, CASE WHEN count(*) FILTER (bad) > 0 THEN '#DIV/0!' END AS total_error,
       CAST(CAST(sum(coalesce(q, -1)) AS DECIMAL(30,2)) AS DOUBLE) AS trapped, CASE WHEN count(*) FILTER (bad) > 0 THEN -2.0::DOUBLE ELSE 0.0::DOUBLE END AS fallback FROM v GROUP BY c_mktsegment""")
def agg_errors(spark, sf_dir):
    """An error value in a column is the result of its aggregates, but for COUNT; IFERROR traps it in rows or around."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    sheet = Sheet(df, {"A": "c_acctbal", "B": "c_nationkey"}, order=["c_custkey"], within=["c_mktsegment"]).add("C", "ratio", "=A1/B1").add("D", "safe", "=IFERROR(C1,-1)")
    two = lambda c: F.col(c).cast("decimal(30,2)").cast("double").alias(c)
    got = sheet.summary({"n": "=COUNT(C:C)", "total": "=SUM(C:C)", "trapped": "=SUM(D:D)", "fallback": "=IFERROR(SUM(C:C)*0,-2)"})
    return got.select("c_mktsegment", F.col("n").cast("bigint").alias("n"), two("total"), "total_error", two("trapped"), "fallback")


_PARTS = """SELECT p_type, split_part(p_type, ' ', 1) || '*' AS w, p_size FROM part"""


@query(f"""
WITH k AS (SELECT DISTINCT w AS criterion FROM ({_PARTS}) UNION SELECT DISTINCT '<>' || w FROM ({_PARTS}) UNION SELECT DISTINCT p_type FROM part UNION SELECT '' UNION SELECT '>=P')
SELECT criterion, (SELECT count(*) FROM part WHERE CASE WHEN criterion = '' THEN p_type IS NULL OR p_type = '' WHEN criterion = '>=P' THEN upper(p_type) >= 'P'
         WHEN criterion LIKE '<>%' THEN NOT starts_with(upper(p_type), upper(replace(substr(criterion, 3), '*', ''))) WHEN criterion LIKE '%*' THEN starts_with(upper(p_type), upper(replace(criterion, '*', ''))) ELSE upper(p_type) = upper(criterion) END) AS n,
       (SELECT CAST(coalesce(sum(p_size), 0) AS DOUBLE) FROM part WHERE CASE WHEN criterion = '' THEN p_type IS NULL OR p_type = '' WHEN criterion = '>=P' THEN upper(p_type) >= 'P'
         WHEN criterion LIKE '<>%' THEN NOT starts_with(upper(p_type), upper(replace(substr(criterion, 3), '*', ''))) WHEN criterion LIKE '%*' THEN starts_with(upper(p_type), upper(replace(criterion, '*', ''))) ELSE upper(p_type) = upper(criterion) END) AS sizes FROM k""")
def criteria_per_row(spark, sf_dir):
    """COUNTIF and SUMIF by each row's criterion: plain texts by key, wildcards, negations, comparisons and blanks by what they say."""
    part = read(spark, sf_dir, "part").select("p_type", "p_size")
    word = F.concat(F.substring_index("p_type", " ", 1), F.lit("*"))
    criteria = part.select(F.explode(F.array(word, F.concat(F.lit("<>"), word), F.col("p_type"), F.lit(""), F.lit(">=P"))).alias("criterion")).distinct()
    sheet = Sheet(criteria, {"A": "criterion"}, others={"Part": Sheet(part, {"A": "p_type", "B": "p_size"})})
    df = sheet.add("B", "n", "=COUNTIF(Part!A:A,A1)").add("C", "sizes", "=SUMIF(Part!A:A,A1,Part!B:B)").df
    return df.select("criterion", F.col("n").cast("bigint").alias("n"), "sizes")


@query("""
SELECT c_custkey, CAST(count(o_orderkey) AS DOUBLE) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS finished, CAST(CAST(avg(o_totalprice) AS DECIMAL(30,8)) AS DOUBLE) AS mean, CAST(count(*) FILTER (o_totalprice >= c_acctbal) AS DOUBLE) AS above
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal""")
def countifs_keyed(spark, sf_dir):
    """COUNTIF, COUNTIFS and AVERAGEIF by each row's key; a balance of each row as a bound is met through a column of the orders."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    rows = Sheet(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), {"A": "o_custkey", "B": "o_totalprice", "C": "o_orderstatus"}, order=["o_orderkey"], others={"C": Sheet(customer, {"A": "c_custkey", "B": "c_acctbal"}, order=["c_custkey"])})
    rows = rows.add("D", "balance", "=VLOOKUP(A1,C!A:B,2,FALSE)").add("E", "over", "=IF(IFERROR(B1>=D1,FALSE),1,0)")
    sheet = Sheet(customer, {"A": "c_custkey"}, others={"O": rows}).add("B", "n", "=COUNTIF(O!A:A,A1)").add("C", "finished", '=COUNTIFS(O!A:A,A1,O!C:C,"f")').add("D", "mean", "=AVERAGEIF(O!A:A,A1,O!B:B)").add("E", "above", "=COUNTIFS(O!A:A,A1,O!E:E,1)")
    return sheet.df.select("c_custkey", "n", "finished", F.col("mean").cast("decimal(30,8)").cast("double").alias("mean"), "above")


@query("""
SELECT p_brand, CAST(avg(p_size) AS DECIMAL(30,4))::DOUBLE AS mean, max(p_size)::DOUBLE AS high, min(p_size)::DOUBLE AS low, CAST(quantile_cont(p_size, 0.25) AS DECIMAL(30,4))::DOUBLE AS q1, CAST(var_samp(p_size) AS DECIMAL(30,4))::DOUBLE AS v, CAST(median(p_size) AS DECIMAL(30,4))::DOUBLE AS mid,
       count(*) FILTER (p_size > 25)::DOUBLE AS large, sum(p_size * p_size)::DOUBLE AS squares, CAST(sqrt(var_pop(p_size)) AS DECIMAL(30,4))::DOUBLE AS sd FROM part GROUP BY p_brand""")
def agg_more(spark, sf_dir):
    """AVERAGEA, MAXA, MINA, QUARTILE.INC, VAR, MEDIAN, SUMPRODUCT and STDEVP of each group."""
    sheet = Sheet(read(spark, sf_dir, "part").select("p_brand", "p_size"), {"A": "p_size"}, within=["p_brand"])
    df = sheet.summary({"mean": "=AVERAGEA(A:A)", "high": "=MAXA(A:A)", "low": "=MINA(A:A)", "q1": "=QUARTILE.INC(A:A,1)", "v": "=VAR(A:A)", "mid": "=MEDIAN(A:A)", "large": "=SUMPRODUCT((A:A>25)*1)", "squares": "=SUMPRODUCT(A:A,A:A)", "sd": "=STDEVP(A:A)"})
    return df.select("p_brand", *[_r4(F.col(c)).alias(c) if c in ("mean", "q1", "v", "mid", "sd") else F.col(c) for c in ("mean", "high", "low", "q1", "v", "mid", "large", "squares", "sd")])
