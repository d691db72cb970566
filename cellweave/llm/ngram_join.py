"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Documents with the same set of word n-grams form one node, so copies never meet each other. Band and row counts
are chosen so that a pair at the threshold shares a band with the wanted probability. Nodes meet in the buckets of their
band hashes. To compare each pair once and to move each text a few times only, every node gets a home (the least node met
through shared buckets, two steps far); pairs with one home are compared there, other pairs in the first bucket they
share. Groups beyond BLOCK nodes or BLOCK_GRAMS n-grams are cut into blocks and each pair of blocks is a task of its own, so no group
is ever in one place. A task gives each node's number of links and a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Remembered, only, shipped, written

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Nodes and n-grams of a block, on average; a task holds two blocks.
BLOCK, BLOCK_GRAMS = 256, 500_000
_CHUNK = 1 << 14
_MULTIPLIER = 0x9E3779B97F4A7C15
_SIGNED = "doc_id bigint, rk1 bigint, rk2 bigint, node binary, n_grams int, bands array<bigint>"
_FOUND = "node binary, other binary, links bigint"


def bands_and_rows(threshold: float, recall: float) -> tuple[int, int]:
    """(bands, rows): the fewest bands for each number of rows that reach the recall at the threshold; of these the
    cheapest, counting a hash for each row of a band and 200 for the chance that a pair below the threshold meets."""
    best = None
    for rows in range(1, 13):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        chance = sum(1 - (1 - (threshold * (i + 0.5) / 50) ** rows) ** bands for i in range(50)) / 50
        cost = bands * rows + 200 * chance
        if best is None or cost < best[0]:
            best = cost, bands, rows
    return best[1], best[2]


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


_word_hashes = Remembered(_word_hash, 250_000, "ngrams")


def shingles(text: bytes, n: int = WORDS):
    """Sorted distinct 64-bit hashes of the text's word n-grams; of all its words where they are fewer; none without words."""
    import numpy as np

    words = text.split()  # bytes split at exactly the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h = h * np.uint64(_MULTIPLIER) + w[i : len(w) - k + 1 + i]
    return np.unique(_mixed(h + np.uint64(k)))


def node_of(grams) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


@lru_cache(maxsize=8)
def _permutations(n: int):
    """Factors (odd) and offsets of n hash functions; always the same."""
    import numpy as np

    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def band_hashes(grams, bands: int, rows: int):
    """A 64-bit hash for each band of ``rows`` MinHash values."""
    import numpy as np

    a, b = _permutations(bands * rows)
    least = None
    for at in range(0, len(grams), 2048):
        part = (grams[at : at + 2048, None] * a + b).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    least = _mixed(least).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        out = _mixed(out * np.uint64(_MULTIPLIER) + least[:, i])
    return out.view(np.int64)


def _sign(batches, n: int, bands: int, rows: int):
    import pyarrow as pa

    only("ngrams")
    for batch in batches:
        nodes, sizes, hashes = [], [], []
        for text in batch.column(3):
            grams = shingles(text.as_py() or b"", n)
            nodes.append(node_of(grams) if len(grams) else None)
            sizes.append(len(grams))
            hashes.append(band_hashes(grams, bands, rows) if len(grams) else None)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(3)], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))],
            ["doc_id", "rk1", "rk2", "node", "n_grams", "bands"],
        )


def _row_keys(documents: DataFrame) -> DataFrame:
    """``documents`` and two 64-bit keys that tell rows of different id or text apart, whatever is null."""
    return documents.withColumns({"rk1": F.xxhash64("doc_id", "text"), "rk2": F.xxhash64("text", F.lit(1), "doc_id")})


def _linked(sizes, inter, threshold: Fraction):
    union = sizes[:, None] + sizes[None, :] - inter
    return inter * threshold.denominator >= union * threshold.numerator


def compare(pdf, n: int, threshold: Fraction):
    """Links within one block, or between two blocks, of a home or a bucket: a row (node, null, links) for each node that
    has any, and rows (node, other, 0) of a spanning forest."""
    import numpy as np
    import pandas as pd

    only("ngrams")
    pdf = pdf.drop_duplicates("node")
    sets = [shingles(t or b"", n) for t in pdf["text"]]
    right = np.array([node_of(s) == bytes(k) for s, k in zip(sets, pdf["node"])], bool)
    pdf, sets = pdf[right], [s for s, r in zip(sets, right) if r]
    count = len(sets)
    if count < 2:
        return pd.DataFrame({"node": [], "other": [], "links": []})
    key, bi, bj = bytes(pdf["key"].iloc[0]), pdf["bi"].iloc[0], pdf["bj"].iloc[0]
    mine = pdf["mine"].to_numpy()
    sizes = np.array([len(s) for s in sets], np.int64)
    # overlaps by products of 0/1 matrices, a bounded number of the shared n-grams at a time
    all_grams, where = np.concatenate(sets), np.repeat(np.arange(count), sizes)
    order = np.argsort(all_grams, kind="stable")
    all_grams, where = all_grams[order], where[order]
    number = np.cumsum(np.concatenate(([0], all_grams[1:] != all_grams[:-1])))
    shared = np.bincount(number)[number] > 1
    where, number = where[shared], number[shared]
    number = np.cumsum(np.concatenate(([0], number[1:] != number[:-1]))) if len(number) else number
    inter = np.zeros((count, count), np.int64)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, _CHUNK):
        lo, hi = np.searchsorted(number, [at, at + _CHUNK])
        x = np.zeros((count, min(_CHUNK, int(number[-1]) + 1 - at)), np.float32)
        x[where[lo:hi], number[lo:hi] - at] = 1
        inter += np.rint(x @ x.T).astype(np.int64)
    linked = _linked(sizes, inter, threshold)
    linked &= (mine[:, None] != mine[None, :]) if bi != bj else ~np.eye(count, dtype=bool)
    if len(key) == 8:  # a bucket: only pairs of different homes that share no earlier band
        bands = np.array(pdf["bands"].tolist(), np.int64)
        here = int.from_bytes(key, "big", signed=True)
        at = int(np.flatnonzero(bands[0] == here)[0])
        for b in range(at):
            linked &= bands[:, b][:, None] != bands[:, b][None, :]
        _, home = np.unique(np.array([bytes(h).hex() for h in pdf["home"]]), return_inverse=True)
        linked &= home[:, None] != home[None, :]
    links = linked @ pdf["copies"].to_numpy(np.int64)
    nodes = [bytes(k) for k in pdf["node"]]
    rows = [(nodes[i], None, int(links[i])) for i in np.flatnonzero(links)]
    seen = np.zeros(count, bool)
    for root in np.flatnonzero(links):
        if not seen[root]:
            seen[root] = True
            reached = [root]
            while reached:
                new = np.flatnonzero(linked[reached.pop()] & ~seen)
                seen[new] = True
                reached += new.tolist()
                rows += [(nodes[i], nodes[root], 0) for i in new]
    return pd.DataFrame(rows, columns=["node", "other", "links"])


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node it is connected to. Least labels travel along edges and then along labels."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        met = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("met"))
        near = labels.join(met, labels["node"] == met["a"]).select("node", F.col("label").alias("old"), F.least("label", "met").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(near.join(far, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = new.select("node", "label")
        if not new.filter("old != label").limit(1).count():
            return labels


def _classes(documents: DataFrame, n: int, threshold: float, recall: float):
    """(signed rows, nodes): doc_id, rk1, rk2, node of each row; and for each node copies, first (its least row) and
    class_first (the least row of its class), links."""
    exact = Fraction(threshold).limit_denominator(10_000)
    bands, rows = bands_and_rows(threshold, recall)
    plain = _row_keys(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    ready = shipped(plain.select("doc_id", "rk1", "rk2", F.col("text").cast("binary").alias("text")))
    signed = written(ready.mapInArrow(lambda batches: _sign(batches, n, bands, rows), _SIGNED))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk1", "rk2")
    nodes = written(signed.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(first).alias("first"), F.max("n_grams").alias("n_grams"), F.first("bands").alias("bands")))

    members = nodes.select("node", F.explode("bands").alias("h"))
    # what a group's rows are joined to is written first: such joins are between two shuffles, and Spark can split a hot group
    several = written(members.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("home")).filter("c > 1").select("h", "home"))
    met = written(members.join(several, "h"))  # node, h, least node of the bucket
    home = met.groupBy("node").agg(F.min("home").alias("home"))
    least = written(met.select("node", "h").join(home, "node").groupBy("h").agg(F.min("home").alias("home")))
    home = written(met.select("node", "h").join(least, "h").groupBy("node").agg(F.min("home").alias("home")))

    apart = written(met.select("node", "h").join(home, "node").groupBy("h").agg((F.min("home") != F.max("home")).alias("apart")).filter("apart"))
    at_home = home.select(F.col("home").alias("key"), "node")
    in_bucket = met.select("node", "h").join(apart.select("h"), "h").select(F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("key"), "node")
    groups = written(at_home.union(in_bucket).join(nodes.select("node", "n_grams"), "node"))
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n_grams").alias("s")).filter("c > 1")
    counts = written(sizes.select("key", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("s") / BLOCK_GRAMS)).alias("n_blocks")))
    routes = groups.drop("n_grams").join(counts, "key").withColumn("mine", F.pmod(F.xxhash64("node", "key"), F.col("n_blocks")))
    routes = routes.withColumn("yours", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    routes = routes.select("key", "node", "mine", F.least("mine", "yours").alias("bi"), F.greatest("mine", "yours").alias("bj"))
    routes = routes.join(nodes.join(home, "node").select("node", "home", "copies", "bands", "first.rk1", "first.rk2"), "node")
    # a row that is repeated as it stands comes once
    texts = plain.select("rk1", "rk2", F.col("text").cast("binary").alias("text")).dropDuplicates(["rk1", "rk2"])
    routed = routes.join(texts, ["rk1", "rk2"]).select("key", "bi", "bj", "mine", "node", "home", "copies", "bands", "text")
    found = written(shipped(routed).groupBy("key", "bi", "bj").applyInPandas(lambda pdf: compare(pdf, n, exact), _FOUND))

    links = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    grouped = labels.join(nodes.select("node", "copies", "first"), "node").join(links, "node")
    whole = written(grouped.groupBy("label").agg(F.min("first").alias("class_first")))  # written for the same reason: one class may be most rows
    grouped = grouped.join(whole, "label").select("node", "class_first", "links")
    full = nodes.select("node", "copies", "first").join(grouped, "node", "left")
    full = written(full.select("node", "first", F.coalesce("class_first", "first").alias("class_first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    return plain, signed, full


def ngram_join(documents: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document row: doc_id, set_id (the least doc_id with the same n-grams), class_id (the least doc_id
    connected by links) and n_links (other rows whose n-grams have a Jaccard similarity of ``threshold`` or more).

    Words are ``[^\\x20\\x09-\\x0D]+``; a text with fewer than n words has one n-gram of all its words. A null or empty
    text has no n-grams: it links to nothing and is its own class. Null doc_ids take part; an id is null only
    where all rows of the class have none. Repeated rows are copies of each other. An empty table gives no rows. A pair
    at the threshold is met with probability ``recall`` or more, and never reported below it.
    """
    _, signed, nodes = _classes(documents, n, threshold, recall)
    known = nodes.select("node", F.col("first.doc_id").alias("set_id"), F.col("class_first.doc_id").alias("class_id"), F.col("links").alias("n_links"))
    df = signed.select("doc_id", "node").join(known, "node", "left")
    own = F.col("node").isNull()
    return df.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(documents: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``documents`` with the least doc_id of each class (null ids last), columns as they came; rows
    without words (null, empty or blank texts) all stay. An empty table gives no rows."""
    _, signed, nodes = _classes(documents, n, threshold, recall)
    stay = nodes.select("class_first.rk1", "class_first.rk2").distinct().union(signed.filter("node is null").select("rk1", "rk2").distinct())
    named = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _row_keys(named).select("doc", "rk1", "rk2").join(stay, ["rk1", "rk2"], "left_semi")
    bare = F.length(F.translate(F.coalesce(F.col("doc.text"), F.lit("")), BLANKS, "")) == 0
    # of rows with equal id and text one stays, chosen by the rest of its columns; repeats are reduced before they meet
    once = rows.filter(~bare).groupBy("rk1", "rk2").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return once.select("doc.*").union(rows.filter(bare).select("doc.*"))
