"""Ordered operators without a single-task window: running totals, ranks, first matches and approximate lookups.

Rows are dealt into buckets of the order's values; sums of whole buckets come from a small table, and windows run inside
buckets. Bucket limits are quantiles, so a skewed order still gives even buckets; equal values share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Limits are held in the plan: at most this many buckets, each of about so many rows.
MOST_BUCKETS, BUCKET_ROWS = 4096, 100_000
#: Lookup tables of up to so many different keys are searched in the plan and joined by broadcast.
FEW_KEYS = 1024


def limits(df: DataFrame, order: Column, buckets: int | None = None) -> list[float]:
    """Quantiles of the order's values, ascending and distinct; as many as the data's size asks for, none for a bucket's rows or fewer."""
    n = min(MOST_BUCKETS, buckets or -(-df.count() // BUCKET_ROWS))
    if n < 2:
        return []
    row = df.agg(F.percentile_approx(order.cast("double"), [i / n for i in range(1, n)], 20_000).alias("q")).first()
    return sorted(set(row["q"] or []))


def bucket_of(order: Column, at: list[float]) -> Column:
    """The number of limits at or below a value: by halving, and in long lists by counting within a part of them."""
    value = order.cast("double")

    def tree(low: int, high: int, leaf) -> Column:
        if low == high:
            return leaf(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(heads[mid]), tree(mid + 1, high, leaf)).otherwise(tree(low, mid, leaf))

    if len(at) <= 64:
        heads = at
        return tree(0, len(at), F.lit)
    parts = [at[i : i + 64] for i in range(0, len(at), 64)]
    heads = [p[0] for p in parts[1:]]
    table = F.array(*[F.array(*map(F.lit, p)) for p in parts])
    part = tree(0, len(heads), F.lit)
    return F.coalesce(part * 64 + F.size(F.filter(F.element_at(table, part + 1), lambda x: x <= value)), F.lit(0))


def order_key(df: DataFrame, name: str) -> Column:
    """A double that ascends with a column's values, whatever their type (values that share it share a bucket)."""
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.unix_date(c).cast("double") if kind == "date" else c.cast("timestamp").cast("double") if kind.startswith("timestamp") else c.cast("double")


def numbered(df: DataFrame, order: list[str], name: str = "_n", groups: list[str] | None = None) -> DataFrame:
    """``df`` with each row's place, from 0, in the order of some columns (within ``groups``): places in buckets and the buckets' sizes."""
    groups, key = groups or [], order_key(df, order[0])
    df = df.withColumn("_b", bucket_of(key, limits(df, key)))
    sizes = df.groupBy(*[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_b").alias("_bb")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(groups))]).orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)  # MOST_BUCKETS rows of a group at most
    sizes = sizes.withColumn("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*[f"`{g}`" for g in groups], "_b").orderBy(*[f"`{o}`" for o in order]))
    on = [F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)] + [F.col("_b") == F.col("_bb")]
    return df.withColumn("_i", inside).join(sizes, on).withColumn(name, F.col("_p") + F.col("_i") - 1).drop("_b", "_bb", "_i", "_p", "_c", *[f"_g{i}" for i in range(len(groups))])


def running(df: DataFrame, order: Column, ties: list, sums: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """``df`` with running totals in ascending order: ``sums`` maps names to what is added up; ``ties`` order equal values."""
    at = limits(df, order, buckets)
    df = df.withColumn("_b", bucket_of(order, at)).withColumns({f"_v_{k}": v for k, v in sums.items()})
    whole = df.groupBy("_b").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])  # MOST_BUCKETS rows at most
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_b", *[F.sum(f"_t_{k}").over(before).alias(f"_p_{k}") for k in sums])
    inside = Window.partitionBy("_b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(F.broadcast(whole), "_b")
    df = df.withColumns({k: F.sum(f"_v_{k}").over(inside) + F.coalesce(F.col(f"_p_{k}"), F.lit(0)) for k in sums})
    return df.drop("_b", *[f"_v_{k}" for k in sums], *[f"_p_{k}" for k in sums])


def ranked(df: DataFrame, value: Column, name: str, descending: bool = True, buckets: int | None = None) -> DataFrame:
    """RANK: 1 and the number of rows before, ties sharing the lowest; equal values share a bucket, so ranks are exact."""
    order = -value if descending else value
    at = limits(df, order, buckets)
    df = df.withColumn("_b", bucket_of(order, at))
    whole = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = whole.select("_b", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_p"))
    inside = F.rank().over(Window.partitionBy("_b").orderBy(order))
    return df.join(F.broadcast(whole), "_b").withColumn(name, inside + F.coalesce("_p", F.lit(0))).drop("_b", "_p")


def first_matches(table: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """What an exact lookup sees of a table: for each key (text without regard to case) the first row's values."""
    kind = dict(table.dtypes)[key]
    k = F.upper(F.col(key)) if kind == "string" else F.col(key)
    picked = F.min_by(F.struct(*values), order) if values else F.min(order)
    return table.filter(F.col(key).isNotNull()).groupBy(k.alias("_key")).agg(picked.alias("_hit"), F.min(order).alias("_pos"))


def exact_lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, order: str, values: list[str]) -> DataFrame:
    """``df`` with the looked-up values and ``_found``; a left join, its strategy left to Spark."""
    k = F.upper(F.col(key)) if dict(df.dtypes)[key] == "string" else F.col(key)
    hits = first_matches(table, table_key, order, values)
    out = df.withColumn("_k", k).join(hits, F.col("_k") == F.col("_key"), "left")
    return out.withColumn("_found", F.col("_key").isNotNull()).select(*df.columns, *[F.col(f"_hit.{v}").alias(v) for v in values], "_pos", "_found")


def unsorted(table: DataFrame, key: str, order: str) -> DataFrame:
    """One row, ``inversions``: how many rows have a smaller key than some row before; over 0, approximate lookups refuse.

    Buckets of the order bring their greatest key along, so no task sees the whole table.
    """
    rows = table.filter(F.col(key).isNotNull())
    at = limits(rows, F.col(order))
    rows = rows.withColumn("_b", bucket_of(F.col(order), at))
    tops = rows.groupBy("_b").agg(F.max(key).alias("_top"))
    tops = tops.select("_b", F.max("_top").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    seen = F.max(key).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_seen", F.greatest(seen, F.lit(None).cast(dict(table.dtypes)[key]))).join(F.broadcast(tops), "_b")
    return rows.agg(F.coalesce(F.count_if(F.col(key) < F.greatest(F.col("_seen"), F.col("_before"))), F.lit(0)).alias("inversions"))


def approximate_lookup(df: DataFrame, key: Column, table: DataFrame, table_key: str, values: list[str], above: bool = False, buckets: int | None = None) -> DataFrame:
    """``df`` with the values of the greatest table key at or below ``key`` (``above``: the least at or above), null if none.

    Each table row owns the span up to the next key; spans and keys meet in buckets of the table's quantiles by an
    equi-join, so neither side is crossed with the other. Of equal table keys the last (``above``: the first) by
    ``values`` counts.
    """
    sign = -1 if above else 1
    k = (F.col(table_key) * sign).cast("double")
    last = F.max_by(F.struct(*values), F.struct(*values)) if not above else F.min_by(F.struct(*values), F.struct(*values))
    keys = table.filter(F.col(table_key).isNotNull()).groupBy(k.alias("_lo")).agg(last.alias("_hit"))
    few = [r["_lo"] for r in keys.select("_lo").limit(FEW_KEYS + 1).collect()] if buckets is None else None
    if few is not None and len(few) <= FEW_KEYS:
        at = sorted(few)
        place = keys.select(bucket_of(F.col("_lo"), at).alias("_kb"), "_hit")
        met = df.withColumn("_xb", bucket_of((key * sign).cast("double"), at)).join(F.broadcast(place), F.col("_xb") == F.col("_kb"), "left")
        return met.select(*df.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])
    at = limits(keys, F.col("_lo"), buckets)
    # the next key: within a bucket by a window, at its end the least key of the buckets after
    keys = keys.withColumn("_b", bucket_of(F.col("_lo"), at))
    firsts = keys.groupBy("_b").agg(F.min("_lo").alias("_f"))
    firsts = firsts.select("_b", F.min("_f").over(Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    spans = keys.withColumn("_next", F.lead("_lo").over(Window.partitionBy("_b").orderBy("_lo"))).join(F.broadcast(firsts), "_b")
    spans = spans.withColumn("_hi", F.coalesce("_next", "_after"))
    spans = spans.select("_hit", "_lo", "_hi", F.explode(F.sequence(F.col("_b"), F.coalesce(bucket_of(F.col("_hi"), at), F.lit(len(at))))).alias("_kb"))
    x = (key * sign).cast("double")
    left = df.withColumn("_x", x).withColumn("_xb", bucket_of(F.col("_x"), at))
    met = left.join(spans, (F.col("_xb") == F.col("_kb")) & (F.col("_x") >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col("_x") < F.col("_hi"))), "left")
    return met.select(*df.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])
