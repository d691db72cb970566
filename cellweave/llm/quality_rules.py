"""Quality rules with risk-controlled thresholds (built-in functions only).

Five signals are measured on each whole text. For each signal a grid of cutoffs is tried on the labelled
holdout: of the n good documents of a stratum, k would be rejected. A cutoff is admissible when the exact
binomial upper bound on its false-rejection rate is at most ``alpha / signals``, that is when
P(Binomial(n, alpha / signals) <= k) <= delta / tests, Bonferroni over every (stratum, signal, cutoff) tried. A
labelled document is one trial of its stratum, however often its row is repeated. The tightest admissible cutoff of each signal is used, so with probability 1 - delta no stratum loses more than
``alpha`` of its good documents, all signals together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, words, written

SYMBOLS = "#*$%&|<>"
#: The base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ALPHA, DELTA = 0.02, 0.05
#: Cutoffs tried for each signal: a document is rejected when its signal is above the cutoff (all signals: more is worse).
GRID = {
    "symbol_share": [0.005, 0.01, 0.02, 0.04, 0.08, 0.16],
    "dup_line_share": [0.05, 0.1, 0.2, 0.3, 0.45, 0.6],
    "repeat_share": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4],
    "long_words": [9.0, 10.0, 12.0, 15.0, 20.0, 30.0],
    "short_words": [-4.0, -3.5, -3.0, -2.5, -2.0, -1.5],
}


def signals(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines of a text, and the word array they come from."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    return {
        "w": words(text),
        "lines": lines,
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def measured(documents: DataFrame, keep: list[str], stratum: str) -> DataFrame:
    """``doc``, a struct of the ``keep`` columns (so no name can clash), ``stratum``, and the base counts.

    A window counts as repeated when its 64-bit hash recurs in the text. Windows are hashed and, in texts where
    any recurs, sorted with their positions and compared with their neighbours: n log n for the longest text, no
    explode and no shuffle.
    """
    df = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"),
        F.col(f"`{stratum}`").cast("string").alias("stratum"),
        *[e.alias(a) for a, e in signals(F.col("text")).items()],
    )
    rest = lambda c, k: F.slice(c, k, F.greatest(F.size(c), F.lit(1)))  # noqa: E731  from the k-th element on
    # zip_with pads with null at the end; those last windows are cut off
    triples = F.zip_with(F.zip_with("w", rest("w", 2), lambda a, b: F.xxhash64(a, b)), rest("w", 3), lambda p, c: F.xxhash64(p, c))
    df = df.withColumn("h", F.when(F.size("w") >= 3, F.slice(triples, 1, F.greatest(F.size("w") - 2, F.lit(0)))))
    df = df.withColumn("repeats", F.coalesce(F.size("h") > F.size(F.array_distinct("h")), F.lit(False)))
    df = df.withColumn("s", F.when(F.col("repeats"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.zip_with("s", rest("s", 2), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("p", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))))
    gaps = F.zip_with("p", rest("p", 2), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return df.select(
        "doc",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "long_words": F.col("word_chars") / n,
        "short_words": -(F.col("word_chars") / n),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term in logarithms from the exact recurrence."""
    import math

    step = math.log(p) - math.log1p(-p)
    start = F.struct(n * F.lit(math.log1p(-p)), F.exp(n * F.lit(math.log1p(-p))))
    start = F.struct(start["col1"].alias("t"), start["col2"].alias("s"))
    return F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        start,
        lambda acc, i: F.struct(
            (acc["t"] + F.log((n - i + 1) / i) + F.lit(step)).alias("t"),
            (acc["s"] + F.exp(acc["t"] + F.log((n - i + 1) / i) + F.lit(step))).alias("s"),
        ),
        lambda acc: acc["s"],
    )


def thresholds(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and one cutoff column per signal (null: no cutoff is admissible, the signal rejects nothing).

    ``holdout`` has stratum, good (boolean) and the signal columns. A row for each stratum with good documents.
    """
    counts = [F.count(F.lit(1)).alias("n")]
    for s, cuts in GRID.items():
        counts += [F.count_if(F.col(s) > c).alias(f"{s}_{i}") for i, c in enumerate(cuts)]
    good = holdout.filter("good").groupBy("stratum").agg(*counts)
    good = written(good)
    tests = max(1, good.count()) * sum(map(len, GRID.values()))
    tried = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(c).alias("cut"), F.col(f"{s}_{i}").alias("k")) for s, cuts in GRID.items() for i, c in enumerate(cuts)])
    tail = binomial_tail(F.col("t.k"), F.col("n"), alpha / len(GRID))
    long = good.select("stratum", "n", F.explode(tried).alias("t")).select("stratum", "t.signal", F.when(tail <= delta / tests, F.col("t.cut")).alias("cut"))
    return long.groupBy("stratum").agg(*[F.min(F.when(F.col("signal") == s, F.col("cut"))).alias(f"{s}_cut") for s in GRID])


def _judged(documents: DataFrame, labels: DataFrame, keep: list[str], alpha: float, delta: float, stratum: str) -> DataFrame:
    df = written(measured(documents, keep, stratum))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    df = df.withColumns(_ratios())
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") >= 1).alias("good"))
    # the base rule rejects on its own account: cutoffs are set on what it leaves; a repeated document is judged by its worst row
    holdout = df.filter(~F.col("base_failed") & F.col("stratum").isNotNull()).select(F.col("doc.doc_id").alias("doc_id"), "stratum", *GRID)
    trials = holdout.join(marks, "doc_id").groupBy("doc_id", "stratum", "good").agg(*[F.max(g).alias(g) for g in GRID])
    cuts = written(thresholds(trials, alpha, delta))
    # no size is assumed of the strata: Spark broadcasts the table where it is small and splits hot strata where it is not
    df = df.join(cuts, "stratum", "left")
    over = [F.coalesce(F.col(s) > F.col(f"{s}_cut"), F.lit(False)) for s in GRID]
    return df.withColumn("kept", ~F.col("base_failed") & ~F.greatest(*over))


def quality_rules(documents: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed and kept.

    ``labels`` (doc_id, quality) is the labelled holdout; quality 1 is good, and of several labels of a document the
    highest counts. Labels with null doc_id or quality take no part. A null or empty text has no words and fails
    the base rule. In a null stratum and a stratum without labelled good documents nothing is proven, so only the base rule
    rejects. Repeated rows are judged alike, each on its own. An empty table gives no rows; without labels only
    the base rule rejects.
    """
    df = _judged(documents, labels, ["doc_id"], alpha, delta, stratum)
    return df.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")


def keep_by_rules(documents: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """The rows of ``documents`` that the rules keep, with the columns they came with; nulls, empty texts, repeats and
    empty tables as in ``quality_rules``."""
    return _judged(documents, labels, documents.columns, alpha, delta, stratum).filter("kept").select("doc.*")
