"""Group D: lookups, compiled to joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..formula.values import Refusal
from ..functions.columns import Typed
from ..operators.table import Sheet, matches
from .common import read

QUERIES, SQL = {}, {}
#: A band table, lower bounds and names.
BANDS = ((0.0, "none"), (1000.0, "small"), (50_000.0, "medium"), (150_000.0, "large"), (300_000.0, "huge"))
_VALUES = ", ".join(f"({i}, {k}::DOUBLE, '{v}')" for i, (k, v) in enumerate(BANDS))


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _bands(spark, rows=BANDS) -> Sheet:
    """The band table: A lower bounds, B names."""
    return Sheet(spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "pos int, lower double, name string"), {"A": "lower", "B": "name"}, order=["pos"])


def _orders(spark, sf_dir, bands: Sheet) -> Sheet:
    return Sheet(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), {"A": "o_totalprice"}, others={"Bands": bands})



@query("""
WITH p AS (SELECT * FROM part WHERE p_partkey % 7 <> 0)
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, p_name AS name, CASE WHEN p_partkey IS NULL THEN '#N/A' END AS name_error FROM lineitem LEFT JOIN p ON l_partkey = p_partkey""")
def vlookup_exact(spark, sf_dir):
    """VLOOKUP(key, table, k, FALSE): the first row of each key, joined from the left; a miss is #N/A."""
    table = Sheet(read(spark, sf_dir, "part").filter("p_partkey % 7 <> 0").select("p_partkey", "p_name"), {"A": "p_partkey", "B": "p_name"}, order=["p_partkey"])  # a miss for each seventh key
    lines = Sheet(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), {"A": "l_partkey"}, others={"Part": table})
    return lines.add("B", "name", "=VLOOKUP(A1,Part!A:B,2,FALSE)").df



@query(f"""
WITH b(pos, lower, name) AS (VALUES {_VALUES}) SELECT o_orderkey, name AS band FROM orders ASOF LEFT JOIN b ON o_totalprice >= lower""")
def vlookup_approx(spark, sf_dir):
    """VLOOKUP(…, TRUE) over a sorted band table: its few keys are searched in the plan, larger tables are met in buckets."""
    return _orders(spark, sf_dir, _bands(spark)).add("B", "band", "=VLOOKUP(A1,Bands!A:B,2,TRUE)").df.select("o_orderkey", "band")



@query(f"""
WITH b(pos, lower, name) AS (VALUES {_VALUES}),
d AS (SELECT o_orderkey, o_totalprice AS x FROM orders),
u AS (SELECT o_orderkey, name AS above FROM d ASOF LEFT JOIN b ON x <= lower),
l AS (SELECT o_orderkey, name AS below FROM d ASOF LEFT JOIN b ON x >= lower)
SELECT o_orderkey, coalesce(above, 'beyond') AS next_larger, below AS next_smaller FROM u JOIN l USING (o_orderkey)""")
def xlookup_next(spark, sf_dir):
    """XLOOKUP with match modes 1 and -1 and a fallback."""
    sheet = _orders(spark, sf_dir, _bands(spark)).add("B", "next_larger", '=XLOOKUP(A1,Bands!A:A,Bands!B:B,"beyond",1)').add("C", "next_smaller", "=XLOOKUP(A1,Bands!A:A,Bands!B:B,,-1)")
    return sheet.df.select("o_orderkey", "next_larger", "next_smaller")



@query("""
SELECT c_custkey, n_name AS nation, (c_nationkey * 5 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END)::BIGINT AS cell
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def index_match_2d(spark, sf_dir):
    """INDEX and MATCH: a name by its key's position, and the cell of a grid by the positions of two keys."""
    nations = Sheet(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), {"A": "n_nationkey", "B": "n_name"}, order=["n_nationkey"])
    segments = Sheet(spark.createDataFrame([(j + 1, s) for j, s in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))], "j int, segment string"), {"A": "segment"}, order=["j"])
    sheet = Sheet(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), {"A": "c_nationkey", "B": "c_mktsegment"}, others={"N": nations, "G": segments})
    sheet = sheet.add("C", "nation", "=INDEX(N!B:B,MATCH(A1,N!A:A,0))").add("D", "cell", "=(MATCH(A1,N!A:A,0)-1)*5+MATCH(B1,G!A:A,0)")
    return sheet.df.select("c_custkey", "nation", F.col("cell").cast("bigint").alias("cell"))



@query("SELECT p_type, min(p_partkey) AS position FROM part WHERE upper(p_name) LIKE '%A%E%' GROUP BY p_type")
def match_wildcard(spark, sf_dir):
    """MATCH with wildcards: the least position of a row that fits."""
    df = read(spark, sf_dir, "part")
    return df.filter(matches(Typed(F.col("p_name"), "text"), "*a*e*")).groupBy("p_type").agg(F.min("p_partkey").alias("position"))


@query("""
SELECT o_orderkey, CAST(NULL AS VARCHAR) AS band, 'unsupported' AS status FROM orders""")
def lookup_unsorted_refused(spark, sf_dir):
    """An approximate lookup over unsorted keys is refused, for every row, rather than answered wrongly."""
    sheet = _orders(spark, sf_dir, _bands(spark, BANDS[::-1]))
    try:
        df, status = sheet.add("B", "band", "=VLOOKUP(A1,Bands!A:B,2,TRUE)").df, "computed"
    except Refusal:
        df, status = sheet.df.withColumn("band", F.lit(None).cast("string")), "unsupported"
    return df.select("o_orderkey", "band", F.lit(status).alias("status"))



@query(f"""
WITH b(pos, lower, name) AS (VALUES {_VALUES}), d AS (SELECT o_orderkey, o_totalprice AS x FROM orders)
SELECT o_orderkey, pos + 1 AS position, CAST(lower AS DOUBLE) AS reached FROM d ASOF LEFT JOIN b ON x >= lower""")
def hlookup_match_position(spark, sf_dir):
    """MATCH(…,1) and LOOKUP over a band table that lies across: its row is turned into rows first."""
    wide = spark.createDataFrame([tuple(k for k, _ in BANDS)], ", ".join(f"c{i} double" for i in range(len(BANDS))))
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("at"), F.col(f"c{i}").alias("lower")) for i in range(len(BANDS))])).alias("x")).select("x.*")
    sheet = _orders(spark, sf_dir, Sheet(long, {"A": "lower"}, order=["at"])).add("B", "position", "=MATCH(A1,Bands!A:A,1)").add("C", "reached", "=LOOKUP(A1,Bands!A:A)")
    return sheet.df.select("o_orderkey", F.col("position").cast("int").alias("position"), "reached")
