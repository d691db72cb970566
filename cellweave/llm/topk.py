"""Exact top-k by inner product, pruned by multi-resolution segment statistics.

Vectors are turned by an orthogonal matrix fitted on a bounded sample, so that the leading coordinates hold most of their
energy; inner products stay what they are. A resolution cuts a vector into segments: its leading coordinates one by one
and one long tail, kept by mean and deviation. For a segment of length L, sum(q*x) <= L * (mean_q * mean_x + dev_q * dev_x)
(Cauchy-Schwarz on the deviations), so segment statistics bound the score from above, which is the lower bound on distance in
this setting: |q - x|^2 = |q|^2 + |x|^2 - 2 q.x. Coarse to fine, a block of candidates goes if its summary bounds it below
every query's k-th best, then a pair if its own statistics do; exact integer products are computed for surviving pairs alone.

Blocks are files: a tile (a group of query blocks and a slice of the candidates' summaries) reads by range only the
blocks that survive, so vectors are never shuffled. A query's k-th best starts from an exact pass over its own block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Files, shared_dir, shipped, written

K, SCALE, EVERY = 20, 64, 20
#: Vectors, and numbers, of a block at most (a block has one vector at least); query blocks of a group and tiles, about.
BLOCK, BLOCK_NUMBERS, GROUP, TILES = 2048, 1 << 21, 4, 256
#: Blocks' worth of vectors that are sorted by their nearest centre before they are cut into blocks, and the centres.
HELD, CENTRES = 16, 64
#: The rotation's bound: so many vectors of up to so many numbers are fitted on the driver, for the commonest lengths.
SAMPLE, MOST_DIMS, MOST_LENGTHS = 1024, 1024, 4
#: Leading coordinates of each resolution, as shares of the vector's length; the first one is that of block summaries.
RESOLUTIONS = (0.25, 0.5, 0.75, 0.875)
_BLOCKS = "kind string, dims int, block long, name string, place long, length long, n int, code string, summary binary"
#: Below every score, and no vec_id: fillers of lists that are not full yet.
_LOWEST, _NONE = -(2**63 - 1), 2**63 - 1
_BEST = "query_id bigint, vec_id bigint, score bigint"


def quantised(vector, scale: int = SCALE):
    """floor(scale * x) of each component as float64, or None where a component is null or not finite."""
    import numpy as np

    if vector is None or any(x is None for x in vector):
        return None
    x = np.floor(scale * np.asarray(vector, np.float64))
    return x if np.isfinite(x).all() else None


def rotation(sample):
    """An orthogonal matrix whose leading columns hold most of the sample's energy."""
    import numpy as np

    with np.errstate(all="ignore"):
        moments = sample.T @ sample
    if not np.isfinite(moments).all():
        return np.eye(sample.shape[1])
    return np.ascontiguousarray(np.linalg.eigh(moments)[1][:, ::-1])


def leading(dims: int) -> list[int]:
    return sorted({max(1, min(dims, math.ceil(dims * r))) for r in RESOLUTIONS})


def tail_statistics(x):
    """(mean, deviation) of each row as one segment, both weighted by the square root of its length."""
    import numpy as np

    if not x.shape[1]:
        return np.zeros(len(x)), np.zeros(len(x))
    mean = x.sum(1) / math.sqrt(x.shape[1])
    return mean, np.sqrt(np.maximum((x**2).sum(1) - mean**2, 0))


def summary(x):
    """Of a block of turned vectors: least and greatest of each leading coordinate of the first resolution, the tail's greatest norm,
    and the greatest norm of all."""
    import numpy as np

    p = leading(x.shape[1])[0]
    return np.concatenate((x[:, :p].min(0), x[:, :p].max(0), [np.sqrt((x[:, p:] ** 2).sum(1)).max(), np.sqrt((x**2).sum(1)).max()]))


class Searcher:
    """The k best candidates so far for each query of a group; candidates come block by block. ``exact`` counts products."""

    def __init__(self, ids, queries, least=None, turn=None, k: int = K):
        import numpy as np

        self.ids, self.queries, self.k, self.turn = ids, queries, k, turn
        self.floor = np.full(len(ids), -np.inf) if least is None else least
        self.row = self.found = self.score = np.empty(0, np.int64)
        self.turned = queries if turn is None else queries @ turn
        self.levels = leading(queries.shape[1])
        self.tails = [tail_statistics(self.turned[:, p:]) for p in self.levels]
        self.norms = np.sqrt((queries**2).sum(1))
        self.exact = 0

    def reached(self, block_summary):
        """Queries whose k-th best a block may reach."""
        import numpy as np

        p = self.levels[0]
        low, high, (tail, norm) = block_summary[:p], block_summary[p : 2 * p], block_summary[2 * p :]
        q = self.turned[:, :p]
        with np.errstate(all="ignore"):
            bound = np.maximum(q, 0) @ high + np.minimum(q, 0) @ low + np.sqrt((self.turned[:, p:] ** 2).sum(1)) * tail
            return np.flatnonzero(~(bound + self._slack(self.norms, norm) < self.floor))

    @staticmethod
    def _slack(q, x):
        return 1e-9 * q * x + 1e-6

    def add(self, ids, vectors, among=None) -> None:
        import numpy as np

        among = np.arange(len(self.ids)) if among is None else among
        turned = vectors if self.turn is None else vectors @ self.turn
        norms = np.sqrt((vectors**2).sum(1))
        tails = [tail_statistics(turned[:, p:]) for p in self.levels]
        step = 512  # so a later part meets the k-th bests that the earlier ones set
        for at in range(0, len(ids), step):
            part = slice(at, min(at + step, len(ids)))
            q, x = self._pairs(among, turned[part], norms[part], [(m[part], d[part]) for m, d in tails])
            q, x = q[(own := self.ids[q] != ids[x + at])], x[own] + at
            if len(q):
                self._merge(q, ids[x], self._products(q, vectors, x))

    def _pairs(self, among, turned, norms, tails):
        """The pairs that no resolution rules out: as matrices while they are many, one by one once they are few."""
        import numpy as np

        with np.errstate(all="ignore"):
            floor = self.floor[among] - self._slack(self.norms[among], float(norms.max()))
            partial, before = 0.0, 0
            for level, (p, (xm, xd), (qm, qd)) in enumerate(zip(self.levels, tails, self.tails)):
                partial = partial + self.turned[among, before:p] @ turned[:, before:p].T
                before = p
                alive = ~(partial + np.outer(qm[among], xm) + np.outer(qd[among], xd) < floor[:, None])
                i, j = np.nonzero(alive)
                if len(i) * 8 < alive.size:
                    break
            some = partial[i, j] if len(i) else None
            for (p, (xm, xd), (qm, qd)) in list(zip(self.levels, tails, self.tails))[level + 1 :]:
                if not len(i):
                    break
                q = among[i]
                some = some + np.einsum("ij,ij->i", self.turned[q, before:p], turned[j, before:p])
                before = p
                keep = ~(some + qm[q] * xm[j] + qd[q] * xd[j] < floor[i])
                i, j, some = i[keep], j[keep], some[keep]
        return among[i], j

    def _products(self, q, vectors, x):
        import numpy as np

        self.exact += len(q)
        rows, columns = np.unique(q), np.unique(x)
        if len(q) * 4 > len(rows) * len(columns):
            return exact_products(self.queries[rows], vectors[columns])[np.searchsorted(rows, q), np.searchsorted(columns, x)]
        most = float(np.abs(self.queries[rows]).max(initial=0)) * float(np.abs(vectors[columns]).max(initial=0)) * vectors.shape[1]
        if most < 2**53:
            return np.rint(np.einsum("ij,ij->i", self.queries[q], vectors[x])).astype(np.int64)
        return np.array([exact_products(self.queries[a : a + 1], vectors[b : b + 1])[0, 0] for a, b in zip(q, x)], np.int64)

    def _merge(self, q, ids, score) -> None:
        import numpy as np

        row, found, score = (np.concatenate(x) for x in ((self.row, q), (self.found, ids), (self.score, score)))
        order = np.lexsort((found, -score, row))
        row, found, score = row[order], found[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.found, self.score = row[kept], found[kept], score[kept]
        last = place[kept] == self.k - 1
        self.floor[self.row[last]] = np.maximum(self.floor[self.row[last]], self.score[last])

    def rows(self):
        return self.ids[self.row], self.found, self.score


def exact_products(a, b):
    """Integer inner products of integral float64 rows; whole numbers beyond 2**53 are multiplied as Python's, and held
    within 64 bits."""
    import numpy as np

    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    bound = -_LOWEST - 1
    return np.array([[max(-bound, min(bound, int(x))) for x in r] for r in whole], np.int64)


def _code(x) -> str:
    """The smallest type that holds whole numbers."""
    most = max(float(x.max(initial=0)), -float(x.min(initial=0)))
    return "<i1" if most < 128 else "<i2" if most < 32768 else "<f8"


class _Packer:
    """Cuts a partition's vectors into blocks, written to one file; gives a row for each block."""

    def __init__(self, name: str, base: int, model: dict, k: int):
        self.name, self.base, self.model, self.k = name, base, model, k
        self.held: dict[int, list] = {}
        self.asked: dict[int, list] = {}
        self.rows: list[tuple] = []
        self.at = 0

    @staticmethod
    def size(dims: int) -> int:
        return max(1, min(BLOCK, BLOCK_NUMBERS // dims))

    def _block(self, kind: str, ids, least, x):
        import numpy as np

        turn = self.model.get(x.shape[1], (None, None))[0]
        code = _code(x)
        data = ids.tobytes() + (least.tobytes() if kind == "q" else b"") + x.astype(code).tobytes()
        with np.errstate(all="ignore"):
            about = summary(x if turn is None else x @ turn).tobytes() if kind == "x" else b""
        self.rows.append((kind, x.shape[1], self.base + len(self.rows), self.name, self.at, len(data), len(ids), code, about))
        self.at += len(data)
        return data

    def _cut(self, dims: int):
        """Blocks of what is held of one length, vectors of one centre together; queries get their k-th best within their block."""
        import numpy as np

        rows = self.held.pop(dims)
        ids, x, query = np.array([r[0] for r in rows], np.int64), np.stack([r[1] for r in rows]), np.array([r[2] for r in rows], bool)
        centres = self.model.get(dims, (None, None))[1]
        if centres is not None:
            with np.errstate(all="ignore"):
                order = np.argsort((x @ centres.T - (centres**2).sum(1) / 2).argmax(1), kind="stable")
            ids, x, query = ids[order], x[order], query[order]
        for at in range(0, len(ids), self.size(dims)):
            own, part, asks = ids[at : at + self.size(dims)], x[at : at + self.size(dims)], np.flatnonzero(query[at : at + self.size(dims)])
            yield self._block("x", own, None, part)
            for lo in range(0, len(asks), 256):
                some = asks[lo : lo + 256]
                score = np.where(own[some][:, None] == own[None, :], _LOWEST, exact_products(part[some], part))
                least = np.full(len(some), -np.inf)
                if len(own) > self.k:
                    least = np.partition(score, -self.k, axis=1)[:, -self.k].astype(np.float64)
                    least[least <= float(_LOWEST)] = -np.inf
                self.asked.setdefault(dims, []).extend(zip(own[some].tolist(), least.tolist(), part[some]))
            while len(self.asked.get(dims, ())) >= self.size(dims):
                yield self._ask(dims)

    def _ask(self, dims: int):
        import numpy as np

        now, self.asked[dims] = self.asked[dims][: self.size(dims)], self.asked[dims][self.size(dims) :]
        return self._block("q", np.array([r[0] for r in now], np.int64), np.array([r[1] for r in now]), np.stack([r[2] for r in now]))

    def chunks(self, batches, scale: int):
        for batch in batches:
            for vec_id, vector, query in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                x = quantised(vector, scale)
                if x is None or vec_id is None or not len(x):
                    continue
                held = self.held.setdefault(len(x), [])
                held.append((vec_id, x, query))
                if len(held) >= HELD * self.size(len(x)) or len(held) * len(x) >= 4 * BLOCK_NUMBERS:
                    yield from self._cut(len(x))
                if len(self.held) > 64:  # vectors of very many lengths
                    yield from self._cut(max(self.held, key=lambda d: len(self.held[d]) * d))
        for dims in list(self.held):
            yield from self._cut(dims)
        for dims in list(self.asked):
            while self.asked[dims]:
                yield self._ask(dims)


def _pack(batches, root: str, model, scale: int, k: int):
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    packer = _Packer(f"blocks-{part:08d}.bin", part << 32, model.value, k)
    Files(root).write(packer.name, packer.chunks(batches, scale))
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in _BLOCKS.split(", ")]
    for at in range(0, len(packer.rows), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packer.rows[at : at + 1000]), kinds)], names)


class _Reader:
    """Blocks by range; the file read last stays open."""

    def __init__(self, root: str):
        self.files, self.name, self.source = Files(root), None, None

    def block(self, kind: str, dims: int, name: str, place: int, length: int, n: int, code: str):
        import numpy as np

        if name != self.name:
            if self.source is not None:
                self.source.close()
            self.name, self.source = name, self.files.open(name)
        self.source.seek(place)
        data = self.source.read(length)
        ids, start = np.frombuffer(data, "<i8", n), 8 * n
        least = None
        if kind == "q":
            least, start = np.frombuffer(data, "<f8", n, start), start + 8 * n
        return ids, least, np.frombuffer(data, code, n * dims, start).reshape(n, dims).astype(np.float64)


def _search(batches, root: str, model, k: int):
    """Rows come sorted by tile, the query blocks first."""
    import numpy as np
    import pyarrow as pa

    reader, searcher, tile, asked = _Reader(root), None, None, []

    def best():
        q, x, s = searcher.rows()
        for at in range(0, len(q), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in (q, x, s)], ["query_id", "vec_id", "score"])

    for batch in batches:
        for this, kind, dims, _, name, place, length, n, code, about in zip(*[batch.column(i).to_pylist() for i in range(10)]):
            if this != tile:
                if searcher is not None:
                    yield from best()
                tile, searcher, asked = this, None, []
            if kind == "q":
                asked.append(reader.block(kind, dims, name, place, length, n, code))
                continue
            if searcher is None:
                if not asked:
                    continue
                ids, least, queries = (np.concatenate(c) for c in zip(*asked))
                asked = []
                searcher = Searcher(ids, queries, least.copy(), model.value.get(dims, (None, None))[0], k)
            among = searcher.reached(np.frombuffer(about, "<f8"))
            if len(among):
                found, _, vectors = reader.block(kind, dims, name, place, length, n, code)
                searcher.add(found, vectors, among)
    if searcher is not None:
        yield from best()


def _model(rows: DataFrame, scale: int) -> dict:
    """For the commonest lengths (rotation, centres), from at most SAMPLE vectors of at most MOST_DIMS numbers, those of least hash."""
    import numpy as np

    short = rows.filter(F.size("embedding").between(1, MOST_DIMS))
    found: dict[int, list] = {}
    for r in short.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).orderBy("h", "embedding").limit(SAMPLE).collect():
        if (x := quantised(r["embedding"], scale)) is not None:
            found.setdefault(len(x), []).append(x)
    common = sorted(found, key=lambda d: (-len(found[d]), d))[:MOST_LENGTHS]
    return {d: (rotation(np.stack(found[d])), np.stack(found[d][:CENTRES])) for d in common}


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query with every other row.

    Queries are the rows whose vec_id is divisible by ``every``; ties go to the smaller vec_id. Vectors that are null, empty
    or hold null or non-finite components, and rows with null vec_id, take no part; vectors of different lengths
    do not meet. A query's own row, and any other row with its vec_id, is no candidate of it; elsewhere rows that repeat a
    vec_id are candidates each, and queries that repeat one share their ranks. Fewer than k
    candidates give fewer rows; an empty table gives none. A task holds one group of queries, their k best so far, and
    one block of candidates at a time; the rotation only decides how much is pruned, never what is found.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("query", F.coalesce(F.col("vec_id") % every == 0, F.lit(False)))
    model, root = spark.sparkContext.broadcast(_model(rows, scale)), shared_dir(spark)  # MOST_LENGTHS matrices of MOST_DIMS rows at most
    blocks = written(shipped(rows).mapInArrow(lambda batches: _pack(batches, root, model, scale, k), _BLOCKS))
    counts = {r["kind"]: r["n"] for r in blocks.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = max(1, math.ceil(counts.get("q", 0) / GROUP))
    slices = max(1, min(counts.get("x", 0), math.ceil(TILES / groups)))
    # (by a number of partitions, which is not coalesced: rows are few and slim, but each asks for much work)
    # names and summaries alone are dealt to the tiles: query blocks of a group to all slices, summaries of a slice to all groups
    dealt = lambda n, salt: F.pmod(F.xxhash64("block", F.lit(salt)), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = blocks.filter("kind = 'q'").withColumn("group", dealt(groups, 1)).withColumn("slice", all_of(slices))
    met = blocks.filter("kind = 'x'").withColumn("group", all_of(groups)).withColumn("slice", dealt(slices, 2))
    tiles = asked.unionByName(met).withColumn("tile", F.concat_ws("/", "dims", "group", "slice"))
    tiles = tiles.select("tile", *[c.split()[0] for c in _BLOCKS.split(", ")]).repartition(min(groups * slices, 20_000), "tile").sortWithinPartitions("tile", "kind", "block")
    best = shipped(tiles).mapInArrow(lambda batches: _search(batches, root, model, k), _BEST)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
