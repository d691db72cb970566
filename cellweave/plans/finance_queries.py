"""Group F: finance and the normal distribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.finance import PROBES
from ..operators.cells import shipped
from ..operators.solvers import rates
from ..operators.table import Sheet
from .common import filled, r6, read, s6, serial

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_G = "power(1 + r, n)"
_PMT = f"(-r * pv * {_G} / ({_G} - 1))"


@query(f"""
WITH p AS (SELECT o_orderkey, (o_custkey % 9 + 1) / 1200.0::DOUBLE AS r, CAST(o_orderkey % 120 + 12 AS DOUBLE) AS n, o_totalprice AS pv FROM orders)
SELECT o_orderkey, {s6(_PMT)} AS payment, {s6(f'-({_G} - 1) / r * -100')} AS saved, {s6(f'100 * ({_G} - 1) / r / {_G}')} AS worth,
       {s6(f'-(pv * power(1 + r, 5) + {_PMT} * (power(1 + r, 5) - 1) / r) * r')} AS interest6, {s6(f'{_PMT} + (pv * power(1 + r, 5) + {_PMT} * (power(1 + r, 5) - 1) / r) * r')} AS principal6,
       CAST(CAST(ln((-pv * 0.02 / r) / (-pv * 0.02 / r + pv)) / ln(1 + r) AS DECIMAL(30,4)) AS DOUBLE) AS periods FROM p""")
def finance_annuity(spark, sf_dir):
    """PMT, FV, PV, IPMT, PPMT and NPER in closed form."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_custkey") % 9 + 1) / F.lit(1200.0)).alias("r"), (F.col("o_orderkey") % 120 + 12).cast("double").alias("n"), F.col("o_totalprice").alias("pv"))
    names = {"payment": "=PMT(A1,B1,C1)", "saved": "=FV(A1,B1,-100)", "worth": "=PV(A1,B1,-100)", "interest6": "=IPMT(A1,6,B1,C1)", "principal6": "=PPMT(A1,6,B1,C1)", "periods": "=NPER(A1,-C1*2%,C1)"}
    df = filled(df, {"A": "r", "B": "n", "C": "pv"}, {n: (chr(68 + i), f) for i, (n, f) in enumerate(names.items())}, ["o_orderkey"])
    return df.select("o_orderkey", *[r6(n).alias(n) for n in names if n != "periods"], F.col("periods").cast("decimal(30,4)").cast("double").alias("periods"))


@query("""
WITH f AS (SELECT o_custkey, o_totalprice * CASE WHEN row_number() OVER w = 1 THEN -3 ELSE 1 END AS v, row_number() OVER w AS k, CAST(o_orderdate AS DATE) - first_value(CAST(o_orderdate AS DATE)) OVER w AS days
           FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, CAST(CAST(sum(v / power(1.1, k)) AS DECIMAL(30,2)) AS DOUBLE) AS npv, CAST(CAST(sum(v / power(1.1, days / 365)) AS DECIMAL(30,2)) AS DOUBLE) AS xnpv,
       CASE WHEN count(*) > 1 THEN CAST(CAST(power(sum(CASE WHEN v > 0 THEN v * power(1.12, n - k) ELSE 0 END) / -sum(CASE WHEN v < 0 THEN v / power(1.1, k - 1) ELSE 0 END), 1 / (max(n) - 1)) - 1 AS DECIMAL(30,6)) AS DOUBLE) END AS mirr
FROM (SELECT *, max(k) OVER (PARTITION BY o_custkey) AS n FROM f) GROUP BY o_custkey""")
def finance_npv_xnpv(spark, sf_dir):
    """NPV, XNPV and MIRR of each customer's flows, in date order."""
    from pyspark.sql.window import Window

    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) == 1
    df = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", serial("o_orderdate").alias("day"), (F.col("o_totalprice") * F.when(first, -3.0).otherwise(1.0)).alias("v"))
    out = Sheet(df, {"A": "v", "B": "day"}, order=["o_orderdate", "o_orderkey"], within=["o_custkey"]).summary({"npv": "=NPV(10%,A:A)", "xnpv": "=XNPV(10%,A:A,B:B)", "mirr": "=MIRR(A:A,10%,12%)"})
    return out.select("o_custkey", *[F.col(n).cast("decimal(30,2)").cast("double").alias(n) for n in ("npv", "xnpv")], r6("mirr").alias("mirr"))


#: The rates that are looked for by brackets; beyond them a root may be found or not, so the query leaves such rates out.
_PROBED = f"CASE WHEN {{0}} BETWEEN {PROBES[0]} AND {PROBES[-1]} THEN {{0}} END"


@query(f"""
WITH RECURSIVE f AS (SELECT o_custkey, o_totalprice * CASE WHEN row_number() OVER w = 1 THEN -3 ELSE 1 END AS v, row_number() OVER w AS k, (CAST(o_orderdate AS DATE) - first_value(CAST(o_orderdate AS DATE)) OVER w) / 365.0::DOUBLE AS years
                     FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
b AS (SELECT o_custkey, list(v ORDER BY k) AS v, list(CAST(k - 1 AS DOUBLE) ORDER BY k) AS p, list(years ORDER BY k) AS y FROM f GROUP BY o_custkey),
g AS (SELECT o_custkey, v, p AS t, 'irr' AS kind FROM b WHERE len(v) > 1 UNION ALL SELECT o_custkey, v, y, 'xirr' FROM b WHERE len(v) > 1),
s AS (SELECT o_custkey, kind, v, t, -10.0::DOUBLE AS low, 12.0::DOUBLE AS high, 0 AS n FROM g
      UNION ALL SELECT o_custkey, kind, v, t, CASE WHEN here > 0 THEN (low + high) / 2 ELSE low END, CASE WHEN here > 0 THEN high ELSE (low + high) / 2 END, n + 1
      FROM (SELECT *, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * exp(-(low + high) / 2 * t[i]))) AS here FROM s WHERE n < 60)),
r AS (SELECT o_custkey, max(exp(low) - 1) FILTER (kind = 'irr') AS irr, max(exp(low) - 1) FILTER (kind = 'xirr') AS xirr FROM s WHERE n = 60 GROUP BY o_custkey)
SELECT b.o_custkey, {s6(_PROBED.format('irr'))} AS irr, {s6(_PROBED.format('xirr'))} AS xirr, CASE WHEN irr IS NOT NULL THEN 0.0::DOUBLE END AS left_over FROM b LEFT JOIN r USING (o_custkey)""")
def finance_irr_rate(spark, sf_dir):
    """IRR and XIRR by a bracketed root of each customer's flows, one outflow and then inflows, so there is one root at most;
    left_over is the value at the rate, 0 to the cent. Rates beyond the probes come as null. The SQL halves the logarithm of growth."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.to_date("o_orderdate")
    df = read(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(w).alias("k"), F.datediff(day, F.min(day).over(Window.partitionBy("o_custkey"))).alias("days"), "o_totalprice")
    df = df.select("o_custkey", "k", "days", (F.col("o_totalprice") * F.when(F.col("k") == 1, -3.0).otherwise(1.0)).alias("v"))
    # one customer's flows are one argument of IRR, so they come together; batches hold many customers
    flows = df.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("k", "v", "days"))).alias("flows"))
    found = shipped(flows).mapInPandas(rates, "o_custkey bigint, irr double, xirr double, left_over double")
    return found.select("o_custkey", *[r6(F.expr(_PROBED.format(n))).alias(n) for n in ("irr", "xirr")], F.abs("left_over").cast("decimal(30,2)").cast("double").alias("left_over"))


@query(f"""
WITH RECURSIVE b AS (SELECT p_partkey, p_retailprice AS cost, p_retailprice * 0.1 AS salvage, CAST(p_size % 8 + 3 AS DOUBLE) AS life FROM part),
d AS (SELECT p_partkey, life, salvage, 1 AS k, cost AS opening, greatest(0, least(cost * 2 / life, cost - salvage)) AS part FROM b
      UNION ALL SELECT p_partkey, life, salvage, k + 1, opening - part, greatest(0, least((opening - part) * 2 / life, opening - part - salvage)) FROM d WHERE k < 3)
SELECT b.p_partkey, {s6('(cost - b.salvage) / b.life')} AS straight, {s6('(cost - b.salvage) * (b.life - 1) * 2 / (b.life * (b.life + 1))')} AS digits2, {s6('d.part')} AS double3,
       {s6('power(1 + 0.12 / b.life, b.life) - 1')} AS effective, {s6('b.life * (power(1.12, 1 / b.life) - 1)')} AS nominal, {s6('power(b.salvage / cost, 1 / b.life) - 1')} AS growth FROM b JOIN d ON b.p_partkey = d.p_partkey AND d.k = 3""")
def finance_depreciation(spark, sf_dir):
    """SLN, SYD, DDB (an aggregate over its periods), EFFECT, NOMINAL and RRI."""
    df = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("cost"), (F.col("p_retailprice") * 0.1).alias("salvage"), (F.col("p_size") % 8 + 3).cast("double").alias("life"))
    names = {"straight": "=SLN(A1,B1,C1)", "digits2": "=SYD(A1,B1,C1,2)", "double3": "=DDB(A1,B1,C1,3)", "effective": "=EFFECT(0.12,C1)", "nominal": "=NOMINAL(0.12,C1)", "growth": "=RRI(C1,A1,B1)"}
    df = filled(df, {"A": "cost", "B": "salvage", "C": "life"}, {n: (chr(68 + i), f) for i, (n, f) in enumerate(names.items())}, ["p_partkey"])
    return df.select("p_partkey", *[r6(n).alias(n) for n in names])


#: The loan of the schedule: amount, yearly rate, payments, extra principal.
LOAN = (850_000, 0.0575, 360, 250)
_PAY = "5961"  # the payment rounded up to a whole amount, so each step is exact in decimals


@query(f"""
WITH RECURSIVE s AS (SELECT 0 AS period, CAST({LOAN[0]} AS DECIMAL(18,2)) AS closing, CAST(0 AS DECIMAL(18,2)) AS interest
  UNION ALL SELECT period + 1, CAST(greatest(0, closing - greatest(0, least(closing, {_PAY} - round(closing * 0.0575 / 12, 2) + {LOAN[3]}))) AS DECIMAL(18,2)), CAST(round(closing * 0.0575 / 12, 2) AS DECIMAL(18,2)) FROM s WHERE period < {LOAN[2]})
SELECT period, CAST(closing AS DOUBLE) AS closing, CAST(interest AS DOUBLE) AS interest FROM s WHERE period > 0""")
def loan_schedule(spark, sf_dir):
    """A rounded, clamped recurrence: one loan is folded over its periods inside the engine and then exploded."""
    d = lambda x: x.cast("decimal(18,2)")
    start = F.array(F.struct(F.lit(0).alias("period"), d(F.lit(LOAN[0])).alias("closing"), d(F.lit(0)).alias("interest")))

    def step(acc, k):
        left = F.element_at(acc, -1)["closing"]
        interest = d(F.round(left * F.lit(0.0575).cast("decimal(5,4)") / 12, 2))
        paid = F.greatest(d(F.lit(0)), F.least(left, d(F.lit(int(_PAY)) - interest + LOAN[3])))
        return F.array_append(acc, F.struct(k.alias("period"), d(F.greatest(d(F.lit(0)), left - paid)).alias("closing"), interest.alias("interest")))

    one = spark.range(1).select(F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(LOAN[2])), start, step)).alias("x"))
    return one.filter("x.period > 0").select("x.period", F.col("x.closing").cast("double").alias("closing"), F.col("x.interest").cast("double").alias("interest"))


@query(f"""
WITH t AS (SELECT p_partkey, (p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part) AS z FROM part),
d AS (SELECT p_partkey, z, exp(-z * z / 2) / sqrt(2 * pi()) AS density FROM t),
c AS (SELECT *, 0.5 + density * list_sum(list_transform(range(0, 80), lambda n: sign(z) * exp((2 * n + 1) * ln(greatest(abs(z), 1e-30)) - (n + 1) * ln(2) - lgamma(n + 1.5) + ln(pi()) / 2))) AS below FROM d)
SELECT p_partkey, {s6('z')} AS z, {s6('below')} AS cdf, {s6('density')} AS pdf, {s6('z')} AS back, {s6('1000 + 50 * z')} AS scaled, {s6('density / 3')} AS thinner FROM c""")
def norm_dist_inv(spark, sf_dir):
    """NORM.S.DIST, its density, NORM.S.INV, NORM.INV and NORM.DIST over standardised prices; back is z again. The SQL sums the series."""
    df = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    stats = df.agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"))
    z = (F.col("p_retailprice") - stats.select("m").scalar()) / stats.select("s").scalar()
    names = {"cdf": "=NORM.S.DIST(A1,TRUE)", "pdf": "=NORM.S.DIST(A1,FALSE)", "back": "=NORM.S.INV(B1)", "scaled": "=NORM.INV(NORM.DIST(A1*3+7,7,3,TRUE),1000,50)", "thinner": "=NORM.DIST(A1*3+7,7,3,FALSE)"}
    df = filled(df.select("p_partkey", z.alias("z")), {"A": "z"}, {n: (chr(66 + i), f) for i, (n, f) in enumerate(names.items())}, ["p_partkey", "z"])
    return df.select("p_partkey", r6("z").alias("z"), *[r6(n).alias(n) for n in names])


@query(f"""
WITH RECURSIVE b AS (SELECT p_partkey, p_retailprice AS pv, (p_size % 9 + 1) / 1200.0::DOUBLE AS r FROM part),
p AS (SELECT *, r * pv * power(1 + r, 24) / (power(1 + r, 24) - 1) AS pay FROM b),
s AS (SELECT p_partkey, r, pay, pv AS owed, 1 AS k FROM p UNION ALL SELECT p_partkey, r, pay, owed - (pay - owed * r), k + 1 FROM s WHERE k < 12)
SELECT p_partkey, {s6('-sum(owed * r)')} AS interest, {s6('-sum(pay - owed * r)')} AS principal FROM s WHERE k BETWEEN 3 AND 12 GROUP BY p_partkey""")
def finance_cumulated(spark, sf_dir):
    """CUMIPMT and CUMPRINC over periods 3 to 12, folded inside the engine."""
    df = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("pv"), ((F.col("p_size") % 9 + 1) / F.lit(1200.0)).alias("r"))
    df = filled(df, {"A": "pv", "B": "r"}, {"interest": ("C", "=CUMIPMT(B1,24,A1,3,12,0)"), "principal": ("D", "=CUMPRINC(B1,24,A1,3,12,0)")}, ["p_partkey"])
    return df.select("p_partkey", r6("interest").alias("interest"), r6("principal").alias("principal"))
