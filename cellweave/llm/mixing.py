"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are put in an order drawn by hash and cut into blocks of about DOCS_PER_BLOCK; a source's quota is
the number of blocks its target needs, whole passes first and then the leading blocks of one more pass, the last of
which is taken in part. A binary tree over the output shards splits the vector of quotas: each left child draws its share
from its parent's blocks without replacement (multivariate hypergeometric, drawn exactly at every size), so every shard is
an exact random sample and all quotas are used up. A shard takes disjoint ranges of each source's permuted list of
blocks, and shuffles what it took locally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shipped, words, written

#: Weights by rank of the source, all targets' share of all sizes, and most times a source repeats.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
DOCS_PER_BLOCK, BLOCKS_PER_SHARD, MOST_PARTITIONS = 128, 32, 20_000
#: Sources are configured by hand, one weight each; more than this is taken for a mistake and refused.
MOST_SOURCES = 100_000
#: The tree's top is split on the driver down to this many nodes at most; below, on the executors.
_TOP = 256


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size: the excess is shared anew until none is above."""
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    left = min(total, most * sum(sizes))
    while free:
        each = left / sum(weights[i] for i in free)
        over = [i for i in free if each * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = each * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def split(quotas, first: int, shards: int, seed: int):
    """Splits the quotas among ``shards`` shards, numbered from ``first``: yields (node's shards, quotas), depth first.

    The draw of a node depends on the seed and the node alone, so any part of the tree can be made anywhere.
    """
    import numpy as np

    if shards == 1:
        yield first, quotas
        return
    half = shards // 2
    left = draw(quotas, first, shards, half, seed)
    yield from split(left, first, half, seed)
    yield from split(np.asarray(quotas) - left, first + half, shards - half, seed)


def draw(quotas, first: int, shards: int, half: int, seed: int):
    """The left child's share of a node's quotas: a multivariate hypergeometric draw, source after source."""
    import numpy as np

    rng = np.random.default_rng([seed, first, shards])
    left = sum(int(q) for q in quotas)
    wanted, out = left * half // shards, []
    for q in map(int, quotas):
        left -= q
        out.append(hypergeometric(rng, q, left, wanted))
        wanted -= out[-1]
    return np.array(out, np.int64)


def _stirling_rest(n: int) -> float:
    """log(n!) less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation where both are near."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, k = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            k += 2
            if total + term / k == total:
                return total
            total += term / k
    return x * math.log(x / mean) + mean - x


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """log P(Binomial(n, p) = x), q = 1 - p, to full precision whatever the size."""
    if x == 0 or x == n:
        return n * math.log(p if x else q) if n else 0.0
    rest = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return rest + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement from good and bad are good: exact inversion at every size, from the mode outwards
    by the recurrence of the probabilities, so the steps are about as many as the standard deviation."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    up = down = at = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    p, q = n / (good + bad), (good + bad - n) / (good + bad)
    over = under = math.exp(_log_binomial(at, good, p, q) + _log_binomial(n - at, bad, p, q) - _log_binomial(n, good + bad, p, q))
    u = rng.random() - over
    while u >= 0:
        if up == high and down == low:
            return at  # rounding left a rest of some 1e-13
        if up < high:
            over *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= over
            if u < 0:
                return up
        if down > low:
            under *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= under
            if u < 0:
                return down
        if over == 0 and under == 0:
            return at
    return at


def _subtrees(batches, seed: int):
    """Rows (src, shard, lo, hi): the range of the source's permuted draws that the shard takes."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for first, shards, quotas, done in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            at = np.array(done, np.int64)
            for shard, q in split(np.array(quotas, np.int64), first, shards, seed):
                src = np.flatnonzero(q)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src.astype("i4")), pa.array(np.full(len(src), shard, "i4")), pa.array(at[src]), pa.array(at[src] + q[src])], ["src", "shard", "lo", "hi"])
                at = at + q


def _tops(quotas, shards: int, seed: int) -> list[tuple]:
    """The nodes at which executors go on: (first shard, shards, quotas, draws of each source before them)."""
    import numpy as np

    nodes = [(0, shards, np.array(quotas, np.int64), np.zeros(len(quotas), np.int64))]
    while len(nodes) < _TOP and any(n[1] > 1 for n in nodes):
        parents, nodes = nodes, []
        for first, n, q, done in parents:
            if n == 1:
                nodes.append((first, n, q, done))
            else:
                left = draw(q, first, n, n // 2, seed)
                nodes += [(first, n // 2, left, done), (first + n // 2, n - n // 2, q - left, done + left)]
    return [(f, s, q.tolist(), d.tolist()) for f, s, q, d in nodes]


def mix(documents: DataFrame, keep: list[str], seed: int = 7, share: float = SHARE, size: Column | None = None) -> DataFrame:
    """One row per document row: ``doc`` (a struct of ``keep``), size, source_size, target, taken and draws.

    ``draws`` is an array of (pass, shard, words, place): the copies the mix takes, their shards, the words taken of
    each, and the order in which the shard reads them. A document's ``taken`` is their words' sum: 0 to MOST times its size.
    Words of a source add up to its target rounded to a whole word. The size of a null or empty text is 0; such
    documents are never taken. A null source is a source of its own. Rows with equal contents are told apart only
    by chance and treated as different documents. An empty table gives no rows. Reruns agree.
    """
    spark = documents.sparkSession
    size = F.size(words(F.col("text"))).cast("long") if size is None else size
    plain = documents.select(F.col("`source`").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "source", "text", F.lit(seed)).alias("key"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"))
    docs = written(plain)  # each later step reads this; the texts are counted once

    stats = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(stats) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in stats]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(stats))], share * sum(sizes))
    rows = []
    for i, (r, t) in enumerate(zip(stats, goal)):
        quota = round(t)
        passes = quota // sizes[i] if sizes[i] else 0
        rows.append((i, r["source"], sizes[i], t, int(passes), quota - passes * sizes[i], max(1, math.ceil(r["n"] / DOCS_PER_BLOCK))))
    sources = spark.createDataFrame(rows, "src int, name string, source_size bigint, target double, passes int, rest bigint, n_blocks bigint")
    few = F.broadcast(sources)  # at most MOST_SOURCES rows
    docs = docs.join(few.select("src", "name", "n_blocks"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # the block is the place of the key among all 64-bit numbers
    docs = docs.withColumn("block", F.floor((F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))) * F.col("n_blocks")).cast("long")).drop("n_blocks")

    # words before each block of its source, in two steps: no task sums a whole source's blocks
    blocks = docs.groupBy("src", "block").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("block") / 1024))
    blocks = written(blocks)
    before = Window.partitionBy("src").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("src", "group").agg(F.sum("words").alias("w")).select("src", "group", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("own", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(groups, ["src", "group"])
    blocks = blocks.join(few.select("src", "passes", "rest", "source_size", "target"), "src").withColumn("before", F.col("base") + F.col("own"))
    blocks = blocks.withColumn("partial", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
    # a block's draws: one for each whole pass and one more if the last pass reaches it; the pass is the position in the array
    blocks = written(blocks.select("src", "block", "words", "partial", "passes", "source_size", "target", F.when(F.col("words") > 0, F.col("passes") + F.when(F.col("partial") > 0, 1).otherwise(0)).otherwise(0).alias("draws")))

    # exact quotas of draws, split by the tree; each source's draws are numbered by pass and rank and permuted
    totals = {r["src"]: int(r["q"]) for r in blocks.groupBy("src").agg(F.sum("draws").alias("q")).collect()}  # a row for each source
    quotas = [totals.get(i, 0) for i in range(len(rows))]
    shards = max(1, math.ceil(sum(quotas) / BLOCKS_PER_SHARD))
    tops = spark.createDataFrame(_tops(quotas, shards, seed), "first int, shards int, quotas array<bigint>, done array<bigint>") if rows else None
    if tops is None:
        return docs.select("doc", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), F.array().cast("array<struct<pass:int,shard:int,words:bigint,place:bigint>>").alias("draws"))
    ranges = shipped(tops.repartition(F.col("first"))).mapInArrow(lambda batches: _subtrees(batches, seed), "src int, shard int, lo bigint, hi bigint")
    places = ranges.select("src", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"))
    drawn = blocks.filter("draws > 0").select("src", "block", F.posexplode(F.array_repeat(F.lit(0), F.col("draws"))).alias("pass", "_")).drop("_")
    # rank of a draw within its source by hash, again in two steps: by hash range, then within the range
    parts = spark.createDataFrame([(i, max(1, math.ceil(q / 1024))) for i, q in enumerate(quotas)], "src int, parts bigint")
    drawn = drawn.withColumn("h", F.xxhash64("src", "block", "pass", F.lit(seed + 1))).join(F.broadcast(parts), "src")
    drawn = drawn.withColumn("part", F.floor((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) * F.col("parts")).cast("long"))
    counts = drawn.groupBy("src", "part").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select("src", "part", F.coalesce(F.sum("c").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("src", "part").orderBy("h", "block", "pass")) - 1
    drawn = drawn.withColumn("r", rank).join(counts, ["src", "part"]).withColumn("pos", F.col("first") + F.col("r"))
    drawn = drawn.join(places, ["src", "pos"]).groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("shards"))  # MOST + 1 of a block

    blocks = blocks.drop("draws").join(drawn, ["src", "block"], "left")
    # only in the one block that the last pass takes in part does the order of its documents matter
    docs = docs.join(blocks, ["src", "block"])
    cut = (F.col("partial") > 0) & (F.col("partial") < F.col("words"))
    # elsewhere each document is a group of its own, so the window meets DOCS_PER_BLOCK rows or so at a time
    upto = Window.partitionBy("src", "block").orderBy("key", F.xxhash64("doc")).rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("earlier", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    last = F.when(cut, F.greatest(F.lit(0), F.least(F.col("size"), F.col("partial") - F.col("earlier")))).otherwise(F.when(F.col("partial") > 0, F.col("size")).otherwise(0))
    taken = (F.col("size") * F.col("passes") + last).cast("long")
    draws = F.filter(
        F.transform(F.coalesce("shards", F.array().cast("array<struct<pass:int,shard:int>>")), lambda s: F.struct(s["pass"].alias("pass"), s["shard"].alias("shard"), F.when(s["pass"] < F.col("passes"), F.col("size")).otherwise(last).cast("long").alias("words"), F.xxhash64(s["shard"], s["pass"], F.col("key"), F.lit(seed + 2)).alias("place"))),
        lambda d: d["words"] > 0,
    )
    return docs.select("doc", "size", "source_size", "target", taken.alias("taken"), draws.alias("draws"))


def mixed_sizes(documents: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards that take the document; edge cases as in ``mix``."""
    return mix(documents, ["doc_id"], seed).select("doc.doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def _row_keys() -> list[Column]:
    """Two 64-bit keys that tell rows of different id, source or text apart, whatever is null."""
    parts = [F.col(c) for c in ("doc_id", "source", "text")]
    return [F.xxhash64(*parts).alias("rk1"), F.xxhash64(*parts[::-1], F.lit(1)).alias("rk2")]


def mixed_documents(documents: DataFrame, seed: int = 7, whole: bool = True) -> DataFrame:
    """The documents as the mix reads them: one row for each copy taken, with the columns they came with, shard by shard and in each shard
    in the order of its own shuffle (as partitions are written).

    A copy taken in part, one of a source at most, is taken whole and unchanged: a source is then above its target by less
    than one document, and none loses its last one. Without ``whole`` such a copy has its leading words, set apart by
    single spaces. Null and empty texts have no words and are never taken; rows equal in id, source and text are taken alike; an
    empty table gives no rows. Texts move twice: to the draws of their block and to their shards.
    """
    keyed = documents.select("doc_id", "source", "text", *_row_keys())
    draws = mix(keyed, ["rk1", "rk2"], seed).filter("size(draws) > 0").select("doc.rk1", "doc.rk2", "size", "draws")
    draws = written(draws.groupBy("rk1", "rk2").agg(F.max("size").alias("size"), F.max("draws").alias("draws")))
    texts = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"), *_row_keys())
    df = texts.join(draws, ["rk1", "rk2"]).select("doc", "size", F.explode("draws").alias("draw"))
    # a shard is a partition, or a run of shards where there are very many; their number is known from the draws
    shards = draws.agg(F.max(F.array_max("draws.shard")).alias("last")).first()["last"]
    parts = 1 if shards is None else min(shards + 1, MOST_PARTITIONS)
    at = F.col("draw.shard") if shards is None or parts > shards else F.floor(F.col("draw.shard") * (parts / (shards + 1))).cast("int")
    df = df.repartitionById(parts, at).sortWithinPartitions("draw.shard", "draw.place")
    if whole:
        return df.select(*[F.col(f"doc.`{c}`").alias(c) for c in documents.columns])
    part = F.array_join(F.slice(words(F.col("doc.text")), 1, F.col("draw.words").cast("int")), " ")
    text = F.when(F.col("draw.words") < F.col("size"), part).otherwise(F.col("doc.text"))
    changed = {"text": text} | ({"n_chars": F.when(F.col("draw.words") < F.col("size"), F.length(text).cast("long")).otherwise(F.col("doc.n_chars"))} if "n_chars" in documents.columns else {})
    return df.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in documents.columns])
