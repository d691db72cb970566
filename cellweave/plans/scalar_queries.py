"""Group A: scalar formulas filled down a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.table import Sheet
from .common import filled, r6, read, s6, serial

#: All queries of this module, filled below.
QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
SELECT p_partkey, {s6('power(-CAST(p_size AS DOUBLE), 2)')} AS neg_square, {s6('power(power(2, 3), 2)')} AS power_left, {s6('1 + 2 * CAST(p_size AS DOUBLE)')} AS mixed,
       {s6('p_retailprice * 0.05')} AS five_percent, {s6('p_retailprice / nullif(p_size - 1, 0)')} AS ratio,
       CASE WHEN p_size = 1 THEN '#DIV/0!' END AS ratio_error FROM part""")
def ops_arith_precedence(spark, sf_dir):
    """Unary minus above ^, ^ to the left, % behind a value, division by zero as an error value."""
    df = filled(read(spark, sf_dir, "part"), {"A": "p_size", "B": "p_retailprice"}, {"neg_square": ("C", "=-A1^2"), "power_left": ("D", "=2^3^2"), "mixed": ("E", "=1+2*A1"), "five_percent": ("F", "=B1*5%"), "ratio": ("G", "=B1/(A1-1)")}, ["p_partkey"])
    return df.select("p_partkey", r6("neg_square").alias("neg_square"), r6("power_left").alias("power_left"), r6("mixed").alias("mixed"), r6("five_percent").alias("five_percent"), r6("ratio").alias("ratio"), "ratio_error")


@query("""
SELECT c_custkey, FALSE AS text_is_number, TRUE AS text_above_number, TRUE AS bool_above_text, c_mktsegment = upper(c_mktsegment) OR upper(c_mktsegment) = 'BUILDING' AS same_case_free,
       upper(c_mktsegment) = 'BUILDING' AS is_building, coalesce(nullif(c_nationkey, 3), 0) = 0 AS blank_is_zero, c_acctbal <> 0 AS nonzero FROM customer""")
def ops_compare_typeclass(spark, sf_dir):
    """Comparison by type class; text without regard to case; blank equals 0."""
    df = read(spark, sf_dir, "customer").withColumn("blank", F.nullif("c_nationkey", F.lit(3)))
    df = filled(df, {"A": "c_mktsegment", "B": "blank", "C": "c_acctbal"}, {"text_is_number": ("D", '="5"=5'), "text_above_number": ("E", "=A1>C1"), "bool_above_text": ("F", "=TRUE>A1"), "same": ("G", "=A1=UPPER(A1)"), "is_building": ("H", '=A1="building"'), "blank_is_zero": ("I", "=B1=0"), "nonzero": ("J", "=C1<>0")}, ["c_custkey", "c_mktsegment"])
    same = (F.col("c_mktsegment") == F.upper("c_mktsegment")) | F.col("is_building")
    return df.withColumn("same_case_free", same & F.col("same")).select("c_custkey", "text_is_number", "text_above_number", "bool_above_text", "same_case_free", "is_building", "blank_is_zero", "nonzero")


_D = "CAST(o_totalprice AS DECIMAL(18,6))"


@query(f"""
SELECT o_orderkey, CAST(round({_D}, 1) AS DOUBLE) AS r1, CAST(round({_D} / 1000, 0) * 1000 AS DOUBLE) AS r_thousand,
       CAST(ceil({_D} * 10) / 10 AS DOUBLE) AS up1, CAST(floor({_D} * 10) / 10 AS DOUBLE) AS down1, CAST(floor({_D}) AS DOUBLE) AS truncated,
       {s6(f'round({_D} / 0.25, 0) * 0.25')} AS to_quarter, {s6(f'ceil({_D} / 5) * 5')} AS ceiling5, {s6(f'floor({_D} / 5) * 5')} AS floor5 FROM orders""")
def round_family(spark, sf_dir):
    """Rounding of the decimal that is shown, half away from zero."""
    names = {"r1": "=ROUND(A1,1)", "r_thousand": "=ROUND(A1,-3)", "up1": "=ROUNDUP(A1,1)", "down1": "=ROUNDDOWN(A1,1)", "truncated": "=TRUNC(A1)", "to_quarter": "=MROUND(A1,0.25)", "ceiling5": "=CEILING(A1,5)", "floor5": "=FLOOR(A1,5)"}
    df = filled(read(spark, sf_dir, "orders"), {"A": "o_totalprice"}, {n: (chr(66 + i), f) for i, (n, f) in enumerate(names.items())}, ["o_orderkey"])
    return df.select("o_orderkey", *[(r6(n) if n in ("to_quarter", "ceiling5", "floor5") else F.col(n)).alias(n) for n in names])


@query(f"""
SELECT c_custkey, {s6('c_acctbal - 7 * floor(c_acctbal / 7)')} AS mod7, {s6('c_acctbal + 7 * floor(c_acctbal / -7)')} AS mod_minus7, floor(c_acctbal) AS int_part,
       trunc(c_acctbal / 7) AS quotient, sign(c_acctbal) * 2 * ceil(abs(c_acctbal) / 2) AS even_up,
       CASE WHEN c_acctbal = 0 THEN 1 ELSE sign(c_acctbal) * (2 * ceil((abs(c_acctbal) - 1) / 2) + 1) END AS odd_up FROM customer""")
def mod_int_sign(spark, sf_dir):
    """MOD takes the divisor's sign, INT floors, QUOTIENT truncates, EVEN and ODD go away from zero."""
    names = {"mod7": "=MOD(A1,7)", "mod_minus7": "=MOD(A1,-7)", "int_part": "=INT(A1)", "quotient": "=QUOTIENT(A1,7)", "even_up": "=EVEN(A1)", "odd_up": "=ODD(A1)"}
    df = filled(read(spark, sf_dir, "customer"), {"A": "c_acctbal"}, {n: (chr(66 + i), f) for i, (n, f) in enumerate(names.items())}, ["c_custkey"])
    return df.select("c_custkey", *[(r6(n) if n.startswith("mod") else F.col(n).cast("double")).alias(n) for n in names])


@query("""
SELECT p_partkey, p_name[1:4] AS l4, p_name[-3:] AS r3, substr(p_name, 3, 5) AS mid5, upper(p_name) AS up, trim(regexp_replace('  ' || p_name || '   x ', ' +', ' ', 'g')) AS trimmed,
       CAST(length(p_name) AS DOUBLE) AS len, replace(p_name, 'a', '_') AS swapped, CASE WHEN strpos(p_name, 'a') > 0 THEN CAST(strpos(p_name, 'a') AS DOUBLE) END AS found,
       CASE WHEN strpos(p_name, 'a') = 0 THEN '#VALUE!' END AS found_error, repeat('ab', p_size % 3) AS twice, p_brand || '-' || p_type AS joined FROM part""")
def text_scalars(spark, sf_dir):
    df = read(spark, sf_dir, "part").withColumn("few", F.col("p_size") % 3)
    names = {"l4": "=LEFT(A1,4)", "r3": "=RIGHT(A1,3)", "mid5": "=MID(A1,3,5)", "up": "=UPPER(A1)", "trimmed": '=TRIM("  "&A1&"   x ")', "len": "=LEN(A1)", "swapped": '=SUBSTITUTE(A1,"a","_")', "found": '=FIND("a",A1)', "twice": '=REPT("ab",B1)', "joined": '=C1&"-"&D1'}
    df = filled(df, {"A": "p_name", "B": "few", "C": "p_brand", "D": "p_type"}, {n: (chr(69 + i), f) for i, (n, f) in enumerate(names.items())}, ["p_partkey"])
    return df.select("p_partkey", *names, "found_error")


@query("""
SELECT o_orderkey, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(CAST(x AS DECIMAL(18,2)) AS VARCHAR), '0') END || ' USD' AS label FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)""")
def text_number_general(spark, sf_dir):
    """Numbers joined to text are written in General format."""
    return filled(read(spark, sf_dir, "orders"), {"A": "o_totalprice"}, {"label": ("B", '=A1&" USD"')}, ["o_orderkey"])


@query("""
SELECT o_orderkey, CAST(d - DATE '1899-12-30' AS DOUBLE) AS serial, CAST(year(d) AS DOUBLE) AS y, CAST(month(d) AS DOUBLE) AS m, CAST(day(d) AS DOUBLE) AS dd, CAST(isodow(d) AS DOUBLE) AS weekday2,
       CAST(last_day(d + INTERVAL 1 MONTH) - DATE '1899-12-30' AS DOUBLE) AS month_end, CAST(CAST(d + INTERVAL 3 MONTH AS DATE) - DATE '1899-12-30' AS DOUBLE) AS later,
       CAST(DATE '2002-01-01' - d AS DOUBLE) AS days_left, CAST(make_date(year(d), 1, 1) - DATE '1899-12-30' AS DOUBLE) AS new_year
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def date_parts_serial(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumn("serial", serial("o_orderdate"))
    names = {"y": "=YEAR(A1)", "m": "=MONTH(A1)", "dd": "=DAY(A1)", "weekday2": "=WEEKDAY(A1,2)", "month_end": "=EOMONTH(A1,1)", "later": "=EDATE(A1,3)", "days_left": "=DAYS(DATE(2002,1,1),A1)", "new_year": "=DATE(YEAR(A1),1,1)"}
    return filled(df, {"A": "serial"}, {n: (chr(66 + i), f) for i, (n, f) in enumerate(names.items())}, ["o_orderkey", "serial"]).select("o_orderkey", "serial", *names)


@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS b FROM orders),
e AS (SELECT o_orderkey, a, b, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS x FROM d),
n AS (SELECT o_orderkey, count(*) FILTER (isodow(x) <= 5) AS n FROM e GROUP BY o_orderkey),
w AS (SELECT o_orderkey, a, row_number() OVER (PARTITION BY o_orderkey ORDER BY x) AS k, CAST(x AS DATE) AS x FROM (SELECT o_orderkey, a, unnest(generate_series(a + 1, a + 21, INTERVAL 1 DAY)) AS x FROM d) WHERE isodow(x) <= 5)
SELECT d.o_orderkey, CAST(n.n AS DOUBLE) AS working, CAST(w.x - DATE '1899-12-30' AS DOUBLE) AS due,
       CAST(CAST(((year(b) - year(d.a)) * 360 + (month(b) - month(d.a)) * 30 + CASE WHEN day(d.a) = day(last_day(d.a)) AND month(d.a) = 2 AND month(b) = 2 AND day(b) = day(last_day(b)) THEN 30
            WHEN day(b) = 31 AND (CASE WHEN day(d.a) = day(last_day(d.a)) THEN 30 ELSE day(d.a) END) >= 30 THEN 30 ELSE day(b) END - CASE WHEN day(d.a) = day(last_day(d.a)) THEN 30 ELSE day(d.a) END) / 360 AS DECIMAL(30,6)) AS DOUBLE) AS years,
       CAST((year(b) - year(d.a)) * 12 + month(b) - month(d.a) - CASE WHEN day(b) < day(d.a) THEN 1 ELSE 0 END AS DOUBLE) AS months
FROM d JOIN n USING (o_orderkey) JOIN w ON w.o_orderkey = d.o_orderkey AND w.k = 10""")
def date_business_days(spark, sf_dir):
    """NETWORKDAYS, WORKDAY, YEARFRAC and DATEDIF in closed form."""
    df = read(spark, sf_dir, "orders").withColumn("a", serial("o_orderdate")).withColumn("b", F.col("a") + F.col("o_orderkey") % 90)
    df = filled(df, {"A": "a", "B": "b"}, {"working": ("C", "=NETWORKDAYS(A1,B1)"), "due": ("D", "=WORKDAY(A1,10)"), "years": ("E", "=YEARFRAC(A1,B1)"), "months": ("F", '=DATEDIF(A1,B1,"M")')}, ["o_orderkey"])
    return df.select("o_orderkey", "working", "due", r6("years").alias("years"), "months")


@query(f"""
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
       CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE CAST(left(o_orderpriority, 1) AS INTEGER) WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS chosen,
       CASE WHEN CAST(left(o_orderpriority, 1) AS INTEGER) > 3 THEN '#VALUE!' END AS chosen_error, coalesce({s6('o_totalprice / nullif(o_custkey % 3, 0)')}, -1) AS safe,
       CASE WHEN o_custkey % 3 = 0 THEN '#N/A' END AS first_true_error, CASE o_custkey % 3 WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS first_true FROM orders""")
def if_ifs_switch(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumn("k", F.substring("o_orderpriority", 1, 1).cast("double")).withColumn("third", (F.col("o_custkey") % 3).cast("double"))
    df = filled(df, {"A": "o_totalprice", "B": "o_orderstatus", "C": "k", "D": "third"}, {"band": ("E", '=IF(A1>200000,"high",IF(A1>100000,"mid","low"))'), "state": ("F", '=SWITCH(B1,"f","done","o","open","other")'), "chosen": ("G", '=CHOOSE(C1,"a","b","c")'), "safe": ("H", "=IFERROR(A1/D1,-1)"), "first_true": ("I", '=IFS(D1=1,"one",D1=2,"two")')}, ["o_orderkey"])
    return df.select("o_orderkey", "band", "state", "chosen", "chosen_error", r6("safe").alias("safe"), "first_true", "first_true_error")


@query("""
SELECT event_id, v IS NULL AS is_blank, v IS NOT NULL AS is_number, FALSE AS is_text, coalesce(v, 0) AS n_value, CASE WHEN v IS NULL THEN event_type ELSE event_type END AS t_value,
       CAST(1 AS DOUBLE) AS type_num, CAST(2 AS DOUBLE) AS type_text, user_id % 2 = 0 AS even, CASE WHEN user_id % 5 = 0 THEN CAST(2 AS DOUBLE) END AS error_type, CASE WHEN user_id % 5 <> 0 THEN '#N/A' END AS error_type_error
FROM (SELECT *, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)""")
def info_predicates(spark, sf_dir):
    df = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("user_id") % 7 != 0, F.col("value"))).withColumn("fifth", (F.col("user_id") % 5).cast("double"))
    names = {"is_blank": "=ISBLANK(A1)", "is_number": "=ISNUMBER(A1)", "is_text": "=ISTEXT(A1)", "n_value": "=N(A1)", "t_value": "=T(B1)", "type_num": "=TYPE(A1)", "type_text": "=TYPE(B1)", "even": "=ISEVEN(D1)", "error_type": "=ERROR.TYPE(1/C1)"}
    return filled(df, {"A": "v", "B": "event_type", "C": "fifth", "D": "user_id"}, {n: (chr(69 + i), f) for i, (n, f) in enumerate(names.items())}, ["event_id"])


@query("""
SELECT p_partkey, CAST(unicode(p_name) AS DOUBLE) AS code, chr(CAST(65 + p_size % 26 AS INTEGER)) AS letter, CASE WHEN p_retailprice < 0 THEN '-' ELSE '' END || format('{:,.1f}', abs(CAST(round(CAST(p_retailprice AS DECIMAL(18,6)), 1) AS DOUBLE))) AS fixed1,
       '$' || format('{:,.2f}', p_retailprice) AS dollars, CAST(CAST(round(CAST(p_size AS DECIMAL(18,6)) / 50 * 100, 1) AS DECIMAL(18,1)) AS VARCHAR) || '%' AS percent, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded,
       concat_ws('/', nullif(p_brand, ''), nullif(p_type, '')) AS joined, CASE WHEN regexp_matches(p_name, '(?i)a.e') THEN CAST(length(regexp_extract(p_name, '^(?i:(.*?))(?i:a.e)', 1)) + 1 AS DOUBLE) END AS found, CASE WHEN NOT regexp_matches(p_name, '(?i)a.e') THEN '#VALUE!' END AS found_error FROM part""")
def text_formats(spark, sf_dir):
    """CODE, CHAR, FIXED, DOLLAR, TEXT, TEXTJOIN and SEARCH with wildcards."""
    names = {"code": "=UNICODE(A1)", "letter": "=CHAR(65+MOD(B1,26))", "fixed1": "=FIXED(C1,1)", "dollars": "=DOLLAR(C1)", "percent": '=TEXT(B1/50,"0.0%")', "padded": '=TEXT(B1,"0000")', "joined": '=TEXTJOIN("/",TRUE,D1,E1)', "found": '=SEARCH("a?e",A1)'}
    df = filled(read(spark, sf_dir, "part"), {"A": "p_name", "B": "p_size", "C": "p_retailprice", "D": "p_brand", "E": "p_type"}, {n: (chr(70 + i), f) for i, (n, f) in enumerate(names.items())}, ["p_partkey"])
    return df.select("p_partkey", *names, "found_error")


@query(f"""
SELECT p_partkey, CAST(gcd(p_size * 6, 36) AS DOUBLE) AS divisor, CAST(lcm(p_size, 12) AS DOUBLE) AS multiple, CAST(factorial(p_size % 15) AS DOUBLE) AS fact, {s6("CAST(factorial(20) AS DOUBLE) / CAST(factorial(p_size % 9) AS DOUBLE) / CAST(factorial(20 - p_size % 9) AS DOUBLE)")} AS choose20,
       ceil(p_retailprice / 7) * 7 AS up7, floor(-p_retailprice / 7) * 7 AS down7, CAST(p_size % 24 AS DOUBLE) AS h, CAST(p_size % 60 AS DOUBLE) AS mi FROM part""")
def math_more(spark, sf_dir):
    """GCD, LCM, FACT, COMBIN, CEILING.MATH, FLOOR.MATH and parts of a time of day."""
    names = {"divisor": "=GCD(A1*6,36)", "multiple": "=LCM(A1,12)", "fact": "=FACT(MOD(A1,15))", "choose20": "=COMBIN(20,MOD(A1,9))", "up7": "=CEILING.MATH(B1,7)", "down7": "=FLOOR.MATH(-B1,7)", "h": "=HOUR(TIME(A1,30,0))", "mi": "=MINUTE(TIME(0,A1,0))"}
    df = filled(read(spark, sf_dir, "part"), {"A": "p_size", "B": "p_retailprice"}, {n: (chr(67 + i), f) for i, (n, f) in enumerate(names.items())}, ["p_partkey"])
    return df.select("p_partkey", "divisor", "multiple", "fact", r6("choose20").alias("choose20"), "up7", "down7", "h", "mi")


#: name -> (formula, SQL) over A = p_retailprice / 1000, B = (p_size - 25) / 26 and C = p_size.
_MATH = {
    "absolute": ("=ABS(B1)", "abs(y)"), "sign": ("=SIGN(B1)", "sign(y)"), "exponential": ("=EXP(A1)", "exp(x)"), "root": ("=SQRT(A1)", "sqrt(x)"), "natural": ("=LN(A1)", "ln(x)"), "decimal10": ("=LOG10(A1)", "log10(x)"), "log3": ("=LOG(A1,3)", "ln(x) / ln(3)"), "power": ("=POWER(A1,B1)", "power(x, y)"),
    "circle": ("=PI()*A1", "pi() * x"), "sine": ("=SIN(A1)", "sin(x)"), "cosine": ("=COS(A1)", "cos(x)"), "tangent": ("=TAN(B1)", "tan(y)"), "sineh": ("=SINH(A1)", "(exp(x) - exp(-x)) / 2"), "cosineh": ("=COSH(A1)", "(exp(x) + exp(-x)) / 2"), "tangenth": ("=TANH(A1)", "(exp(x) - exp(-x)) / (exp(x) + exp(-x))"),
    "arcsine": ("=ASIN(B1)", "asin(y)"), "arccosine": ("=ACOS(B1)", "acos(y)"), "arctangent": ("=ATAN(A1)", "atan(x)"), "arctangent2": ("=ATAN2(A1,B1)", "atan2(y, x)"), "in_degrees": ("=DEGREES(A1)", "x * 180 / pi()"), "in_radians": ("=RADIANS(A1)", "x * pi() / 180"), "plus": ("=+A1", "x"),
    "doubling": ("=PDURATION(0.05,A1,2*A1)", "ln(2) / ln(1.05)"), "seconds": ("=SECOND(43000.5+C1/86400)", "p_size"), "clock": ('=TIMEVALUE("12:30:00")+A1*0', "12.5 / 24"), "thirty": ("=DAYS360(43831,43831+C1)", "p_size - CASE WHEN p_size >= 31 THEN 1 ELSE 0 END"),
}


@query("SELECT p_partkey, " + ", ".join(f"{s6(sql)} AS {n}" for n, (_, sql) in _MATH.items()) + " FROM (SELECT p_partkey, p_size, p_retailprice / 1000 AS x, (p_size - 25) / 26.0::DOUBLE AS y FROM part)")
def math_functions(spark, sf_dir):
    """Elementary functions of each row."""
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 1000).alias("x"), ((F.col("p_size") - 25) / F.lit(26.0)).alias("y"))
    df = filled(df, {"A": "x", "B": "y", "C": "p_size"}, {n: (_letter(i), f) for i, (n, (f, _)) in enumerate(_MATH.items())}, ["p_partkey"])
    return df.select("p_partkey", *[r6(n).alias(n) for n in _MATH])


def _letter(i: int) -> str:
    return "D" + chr(65 + i) if i < 26 else "E" + chr(39 + i)


#: name -> (formula, SQL) over A = c_name, B = c_mktsegment and C = c_custkey.
_TEXT = {
    "small": ("=LOWER(A1)", "lower(c_name)"), "title": ("=PROPER(B1)", "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))"), "cleaned": ("=CLEAN(A1&CHAR(9)&CHAR(10))", "c_name"), "same": ("=EXACT(B1,UPPER(B1))", "c_mktsegment = upper(c_mktsegment)"), "differs": ("=EXACT(B1,LOWER(B1))", "c_mktsegment = lower(c_mktsegment)"),
    "replaced": ('=REPLACE(A1,1,9,"C")', "'C' || substr(c_name, 10)"), "joined": ('=CONCATENATE(A1,"-",B1)', "c_name || '-' || c_mktsegment"), "glued": ("=CONCAT(B1,C1)", "c_mktsegment || CAST(c_custkey AS VARCHAR)"), "letter": ("=UNICHAR(65+MOD(C1,26))", "chr((65 + c_custkey % 26)::INTEGER)"), "code": ("=CODE(B1)", "CAST(ascii(c_mktsegment) AS DOUBLE)"),
    "number": ("=VALUE(RIGHT(A1,9))", "CAST(right(c_name, 9) AS DOUBLE)"), "european": ('=NUMBERVALUE("1.000,5",",",".")+C1', "1000.5 + c_custkey::DOUBLE"), "emoji": ('=LEN(B1&UNICHAR(128578))', "CAST(length(c_mktsegment) + 2 AS DOUBLE)"), "after_emoji": ('=FIND("a",UNICHAR(128578)&"xa")+C1', "4 + c_custkey::DOUBLE"), "beyond": ('=MID(UNICHAR(128578)&B1,3,3)', "substr(c_mktsegment, 1, 3)"),
    "day": ('=DATEVALUE("2026-7-25")+C1', "46228 + c_custkey::DOUBLE"),
}


@query("SELECT c_custkey, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in _TEXT.items()) + " FROM customer")
def text_more(spark, sf_dir):
    """More text functions of each row; lengths and places count UTF-16 units."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    sheet = Sheet(df, {"A": "c_name", "B": "c_mktsegment", "C": "c_custkey"})
    for i, (n, (f, _)) in enumerate(_TEXT.items()):
        sheet = sheet.add(_letter(i), n, f)
    return sheet.df.select("c_custkey", *_TEXT)


#: name -> (formula, SQL) over A = c_acctbal, B = c_nationkey and C = c_mktsegment.
_LOGIC = {
    "trapped": ("=IFERROR(IFNA(A1/B1,-1),-2)", "CASE WHEN b = 0 THEN -2 ELSE a / b END"), "missing": ("=IFNA(IF(B1>12,NA(),B1),5)", "CASE WHEN b > 12 THEN 5 ELSE b END::DOUBLE"), "negated": ("=NOT(B1=0)", "b <> 0"), "failed": ("=ISERROR(A1/B1)", "b = 0"), "failed_other": ("=ISERR(IF(B1=0,NA(),A1/(B1-1)))", "b = 1"), "absent": ("=ISNA(IF(B1=0,NA(),1))", "b = 0"),
    "no_text": ("=ISNONTEXT(C1)", "FALSE"), "truth": ("=ISLOGICAL(B1=0)", "TRUE"), "odd": ("=ISODD(B1)", "b % 2 = 1"), "yes": ("=TRUE()", "TRUE"), "no": ("=FALSE()", "FALSE"), "every": ("=AND(B1>3,A1>0)", "b > 3 AND a > 0"), "some": ("=OR(B1>20,A1<0)", "b > 20 OR a < 0"), "either": ("=XOR(B1>3,A1>0)", "(b > 3) <> (a > 0)"), "is_ref": ("=ISREF(A1)", "TRUE"),
}


@query("SELECT c_custkey, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in _LOGIC.items()) + " FROM (SELECT c_custkey, c_acctbal AS a, c_nationkey AS b, c_mktsegment AS c FROM customer)")
def logic_info(spark, sf_dir):
    """Logical and information functions of each row; error values are trapped or asked about."""
    sheet = Sheet(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"), {"A": "c_acctbal", "B": "c_nationkey", "C": "c_mktsegment"})
    for i, (n, (f, _)) in enumerate(_LOGIC.items()):
        sheet = sheet.add(_letter(i), n, f)
    return sheet.df.select("c_custkey", *_LOGIC)
