"""Group E: shapes that look at other rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordered import running
from ..operators.table import Sheet
from .common import filled, money, r6, read

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderkey) AS DOUBLE) AS total FROM orders")
def running_total(spark, sf_dir):
    """SUM($A$1:A_n): bucket sums and windows inside buckets, never one task."""
    df = running(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey"), [], {"total": money("o_totalprice")})
    return df.select("o_orderkey", F.col("total").cast("double").alias("total"))


@query("""
SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) AS place, c_acctbal >= (SELECT c_acctbal FROM customer ORDER BY c_acctbal DESC LIMIT 1 OFFSET 9) AS top10, CAST((SELECT c_acctbal FROM customer ORDER BY c_acctbal LIMIT 1 OFFSET 4) AS DOUBLE) AS small5 FROM customer""")
def rank_largek(spark, sf_dir):
    """RANK over everything, LARGE and SMALL of a whole column."""
    sheet = Sheet(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), {"A": "c_acctbal"}).add("B", "place", "=RANK(A1,A:A)").add("C", "top10", "=A1>=LARGE(A:A,10)").add("D", "small5", "=SMALL(A:A,5)")
    return sheet.df.select("c_custkey", F.col("place").cast("bigint").alias("place"), "top10", "small5")



@query("""
WITH v AS (SELECT l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY l_partkey),
r AS (SELECT l_partkey, v, sum(v) OVER (ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(v) OVER () AS t FROM v)
SELECT l_partkey, CAST(CAST(CAST(c AS DOUBLE) / CAST(t AS DOUBLE) AS DECIMAL(30,6)) AS DOUBLE) AS share, CASE WHEN CAST(c AS DOUBLE) / CAST(t AS DOUBLE) <= 0.8 THEN 'A' WHEN CAST(c AS DOUBLE) / CAST(t AS DOUBLE) <= 0.95 THEN 'B' ELSE 'C' END AS class FROM r""")
def cumulative_share_abc(spark, sf_dir):
    """SUMIF(rank, "<="&rank, value)/SUM(value) and the cut into A, B and C; equal values share their sum."""
    values = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(money("l_extendedprice")).alias("v"))
    # equal values first become one row, so a running total over rows is one over values
    by_value = values.groupBy("v").agg(F.sum("v").alias("s"))
    run = running(by_value, -F.col("v"), [], {"c": F.col("s")}).select("v", "c")
    df = values.join(run, "v").withColumn("t", values.agg(F.sum("v")).scalar())
    df = filled(df, {"A": "c", "B": "t"}, {"ratio": ("C", "=A1/B1"), "class": ("D", '=IF(C1<=0.8,"A",IF(C1<=0.95,"B","C"))')}, ["l_partkey"])
    return df.select("l_partkey", r6("ratio").alias("share"), "class")


@query("""
WITH m AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ym, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY ALL)
SELECT ym, CAST(v AS DOUBLE) AS v, coalesce(CAST(CAST(CAST(CAST(v AS DOUBLE) / CAST(lag(v) OVER (ORDER BY ym) AS DOUBLE) - 1 AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS VARCHAR), '') AS growth FROM m""")
def prev_row_growth(spark, sf_dir):
    """C7/B7-1 with the row before; "" where there is none. Months are few, so their window is small."""
    m = read(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("ym")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))
    df = Sheet(m, {"A": "ym", "B": "v"}, order=["ym"]).add("C", "first", "=ISBLANK(B1)", base=2).add("D", "ratio", "=B2/B1-1", base=2).df
    return df.select("ym", "v", F.when(F.col("first"), "").otherwise(F.col("ratio").cast("decimal(18,4)").cast("string")).alias("growth"))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY ALL)
SELECT CAST(day - DATE '1899-12-30' AS DOUBLE) AS day, CAST(CAST(avg(CAST(v AS DOUBLE)) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(30,4)) AS DOUBLE) AS trailing FROM d""")
def sliding_avg(spark, sf_dir):
    """AVERAGE of this row and the two before."""
    d = read(spark, sf_dir, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("1899-12-30").cast("date")).cast("double").alias("day")).agg(F.sum(money("value")).cast("double").alias("v"))
    # as in row 3; rows with fewer before them average what there is
    df = Sheet(d, {"A": "day", "B": "v"}, order=["day"]).add("C", "mean", "=AVERAGE(B1:B3)", base=3).df
    return df.select("day", F.col("mean").cast("decimal(30,4)").cast("double").alias("trailing"))


@query("""
SELECT o_orderpriority, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (k < 5000), 0) + coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (k BETWEEN 3000 AND 8000), 0) AS DOUBLE) AS both_areas,
       CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (k BETWEEN 3000 AND 4999), 0) AS DOUBLE) AS shared FROM (SELECT *, o_orderkey AS k FROM orders) GROUP BY o_orderpriority""")
def range_union_intersect(spark, sf_dir):
    """(A,B) keeps duplicates; A B is what both share."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", money("o_totalprice").alias("v"))
    first, second = df.filter("o_orderkey < 5000"), df.filter("o_orderkey between 3000 and 8000")
    union = first.unionAll(second).groupBy("o_orderpriority").agg(F.sum("v").alias("both_areas"))
    shared = first.join(second.select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.sum("v").alias("shared"))
    return union.join(shared, "o_orderpriority", "left").select("o_orderpriority", F.col("both_areas").cast("double").alias("both_areas"), F.coalesce(F.col("shared").cast("double"), F.lit(0.0)).alias("shared"))


@query("""
WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS d, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS u FROM part)
SELECT p_brand, max(v) FILTER (d = 3) AS large3, max(v) FILTER (u = 2) AS small2 FROM r GROUP BY p_brand""")
def large_small_by_group(spark, sf_dir):
    """LARGE and SMALL of each group, by the places of values in buckets, so no group is held whole."""
    sheet = Sheet(read(spark, sf_dir, "part").select("p_brand", "p_retailprice"), {"A": "p_retailprice"}, within=["p_brand"])
    return sheet.summary({"large3": "=LARGE(A:A,3)", "small2": "=SMALL(A:A,2)"}).select("p_brand", "large3", "small2")
