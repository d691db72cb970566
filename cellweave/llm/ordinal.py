"""Quality classifier: ordinal cumulative-link regression on hashed text features.

P(grade <= k | x) = sigmoid(t_k - w.x) with ordered thresholds t and weights w shared by all grades, so one score gives
the whole distribution: its expected grade and the probability of each tail. Features of a text are hashed into a fixed
number of weights: its words, the shapes of its words, and coarse counts of the text as a whole. Only features that go with
a grade more than chance lets any of them have a weight, or the fit would learn its rows by their rare words.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, only, shipped

DIMENSIONS = 1 << 18
#: The fit's bound: at most this many labelled documents, those of least hashed id; a quarter of them is held out.
SAMPLE = 5_000
#: Share of the held-out documents of the selected grade or better that selection keeps at least.
KEEP_SHARE = 0.995
STEPS, RATE, RIDGE = 150, 0.08, 1e-4
_SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))


def _index(kind: bytes, value: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(kind + value) % DIMENSIONS


def _word(raw: bytes) -> int:
    return _index(b"w", raw.strip(b".,;:!?\"'()|#*%$&").lower())


def _shape(raw: bytes) -> int:
    for pattern, by in _SHAPES:
        raw = pattern.sub(by, raw)
    return _index(b"s", raw[:12] + (b"+" if len(raw) > 12 else b""))


#: Both indices of a word in one number: the word's, times DIMENSIONS, and its shape's.
_indices = Remembered(lambda raw: _word(raw) * DIMENSIONS + _shape(raw), 300_000, "ordinal")


def features(text: bytes):
    """(indices, values) of a whole text; an index may occur more than once. Texts without words have the size bucket only."""
    import numpy as np

    raw = text.split()
    n = len(raw)
    counts = Counter(raw)
    size = len(counts)
    coarse = [_index(b"n", b"%d" % int(2 * math.log2(n + 1)))]
    if n:
        lines = [x for x in text.split(b"\n") if x.strip()]
        again = sum(map(bytes.__eq__, raw, raw[1:]))
        for kind, share in ((b"d", size / n), (b"a", again / n), (b"l", 1 - len(set(lines)) / max(1, len(lines))), (b"m", min(1.0, len(text) / n / 20))):
            coarse.append(_index(kind, b"%d" % int(20 * share)))
    tf = np.fromiter(counts.values(), np.float64, size)
    both = np.fromiter(map(_indices.__getitem__, counts), np.int64, size)
    index = np.concatenate((both // DIMENSIONS, both % DIMENSIONS, np.array(coarse, np.int64)))
    value = np.concatenate((0.5 * np.minimum(1.0, 12.0 / max(1.0, math.sqrt(size))) * np.ones(size), 5 * tf / max(1, n), np.full(len(coarse), 0.5)))
    return index, value


class OrdinalModel:
    """Weights and ordered thresholds; ``fit`` minimises the mean negative log likelihood with a ridge, by Adam."""

    def __init__(self, weights, thresholds):
        self.weights, self.thresholds = weights, thresholds

    @staticmethod
    def fit(rows: list[tuple], grades, levels: int, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> "OrdinalModel":
        import numpy as np

        grades = np.asarray(grades, np.int64)
        used, index = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        index, value = index.astype(np.int32), np.concatenate([r[1] for r in rows]).astype(np.float32)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
        n, m = len(rows), len(used)
        share = np.cumsum(np.bincount(grades, minlength=levels) + 1.0)[:-1]
        cuts = np.log(share / (n + levels - share))
        # cuts as a first one and logarithms of the gaps, so they stay ordered
        theta = np.concatenate((np.zeros(m), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))))
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            gaps = np.exp(theta[m + 1 :])
            t = theta[m] + np.concatenate(([0.0], np.cumsum(gaps)))
            score = np.bincount(row, value * theta[index], n)
            edge = np.concatenate(([-np.inf], t, [np.inf]))
            up, low = (1 / (1 + np.exp(-np.clip(edge[grades + k] - score, -60, 60))) for k in (1, 0))
            up, low = np.where(grades == levels - 1, 1.0, up), np.where(grades == 0, 0.0, low)
            p = np.maximum(up - low, 1e-12)
            by_up, by_low = up * (1 - up) / p, low * (1 - low) / p
            slope = (by_up - by_low) / n  # of the loss by the score
            by_cut = np.array([np.sum(by_low[grades == k + 1]) - np.sum(by_up[grades == k]) for k in range(levels - 1)]) / n
            tails = np.cumsum(by_cut[::-1])[::-1]
            gradient = np.concatenate((np.bincount(index, slope[row] * value, m) + ridge * theta[:m], tails[:1], tails[1:] * gaps))
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights = np.zeros(DIMENSIONS)
        weights[used] = theta[:m]
        return OrdinalModel(weights, theta[m] + np.concatenate(([0.0], np.cumsum(np.exp(theta[m + 1 :])))))

    def tails(self, index, value):
        """P(grade > k) for each k below the top grade."""
        import numpy as np

        return 1 / (1 + np.exp(np.clip(self.thresholds - float(self.weights[index] @ value), -60, 60)))


def evidence(rows: list[tuple], grades, levels: int):
    """How surely each feature goes with a grade: the largest of its standard scores over the grades, by the rows it is in.

    0 for features of one row, and for those below the score that the greatest of as many chance features comes to.
    """
    import numpy as np

    grades = np.asarray(grades, np.int64)
    used, index = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    met, score = np.bincount(index, minlength=len(used)), np.zeros(len(used))
    for k in range(levels):
        p = (np.sum(grades == k) + 1) / (len(rows) + levels)
        score = np.maximum(score, np.abs(np.bincount(index, grades[row] == k, len(used)) - met * p) / np.sqrt(met * p * (1 - p) + 1))
    out = np.zeros(DIMENSIONS)
    out[used] = np.where((met > 1) & (score > math.sqrt(2 * math.log(max(1, len(used))))), score, 0.0)
    return out


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 poor, 1 toxic, 2 good; the lowest of several labels counts, null labels take no part."""
    poor, toxic = F.col("quality") < 1, F.coalesce(F.col("toxic"), F.lit(0)) >= 1
    grade = F.when(poor, 0).when(toxic, 1).otherwise(2)
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def _summed(index, value):
    """Each index once, its values added up."""
    import numpy as np

    index, where = np.unique(index, return_inverse=True)
    return index, np.bincount(where, value)


def _sampled(batches):
    only("ordinal")
    for batch in batches:
        found = [_summed(*features(t or b"")) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
            ["doc_id", "grade", "index", "value"],
        )


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_share: float = KEEP_SHARE, levels: int = 3, tail: int | None = None):
    """(model, cut, report): fitted on at most ``sample`` labelled documents on the driver, each feature by its evidence.

    ``cut`` is the tail probability that ``keep_share`` of the held-out documents of grade ``tail`` or better (default:
    the top grade) reach. Without labelled documents the model is None: nothing is rejected.
    """
    import numpy as np

    tail = levels - 1 if tail is None else tail
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    met = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")  # ``sample`` rows at most
    # of several texts with one id the one of least hash is fitted, wherever it stands
    found = shipped(met).mapInArrow(_sampled, "doc_id bigint, grade int, index binary, value binary")
    rows = found.groupBy("doc_id").agg(F.min_by(F.struct("grade", "index", "value"), F.struct(F.xxhash64("index", "value"), "index", "value")).alias("x")).select("doc_id", "x.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["grade"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None, 0.0, {"rows": len(rows)}
    x = [(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(np.float64)) for r in rows]
    held = np.arange(len(x)) % 4 == 3
    fitted = [r for r, h in zip(x, held) if not h]
    scale = evidence(fitted, y[~held], levels)
    sure = [scale[i] > 0 for i, _ in fitted]
    model = OrdinalModel.fit([(i[s], v[s] * scale[i[s]]) for (i, v), s in zip(fitted, sure)], y[~held], levels)
    model.weights *= scale
    tails = np.array([model.tails(*r)[tail - 1] for r, h in zip(x, held) if h])
    good = np.sort(tails[y[held] >= tail])
    cut = float(good[int((1 - keep_share) * len(good))]) if len(good) else 0.0
    cut = min(cut, 0.5)
    report = {"rows": len(rows), "kept_by_grade": {k: float(np.mean(tails[y[held] == k] >= cut)) for k in range(levels) if (y[held] == k).any()}, "cut": cut}
    return model, cut, report


def _scores(texts, state, tail: int):
    """(expected grade, tail probability) of each text; without a model every text reaches the tail."""
    import numpy as np

    only("ordinal")
    model = None
    if state is not None:
        index, weights, thresholds = state.value
        full = np.zeros(DIMENSIONS)
        full[index] = weights
        model = OrdinalModel(full, thresholds)
    found = [model.tails(*features(t.as_py() or b"")) if model else np.ones(tail) for t in texts]
    return pa.StructArray.from_arrays([pa.array([float(t.sum()) for t in found], pa.float64()), pa.array([float(t[tail - 1]) for t in found], pa.float64())], ["expected_grade", "tail_probability"])


def _graded(documents: DataFrame, labels: DataFrame, options: dict):
    """(``documents`` made ready, column with the scores, cut): only texts go to Python and only scores come back."""
    import numpy as np

    tail = options.get("tail") or options.get("levels", 3) - 1
    model, cut, _ = train(documents, labels, **options)
    state = None
    if model is not None:
        index = np.flatnonzero(model.weights)
        state = documents.sparkSession.sparkContext.broadcast((index, model.weights[index], model.thresholds))  # DIMENSIONS weights at most

    @F.arrow_udf(returnType="expected_grade double, tail_probability double")
    def score(texts: pa.Array) -> pa.Array:
        return _scores(texts, state, tail)

    return shipped(documents), score(F.col("text").cast("binary")), cut


def quality_classifier(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, expected_grade (0 to levels - 1), tail_probability (of the selected grade or
    better) and kept. Whole texts; a null or empty text is judged by its size alone. Repeated rows get equal results; where a
    labelled id has several texts one is fitted, the same in any order of rows. Null doc_ids are judged and come back as null. An empty table gives no rows; without labels of two grades every document is kept."""
    df, score, cut = _graded(documents, labels, options)
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("_score"))
    return df.select("doc_id", "_score.expected_grade", "_score.tail_probability", (F.col("_score.tail_probability") >= cut).alias("kept"))


def keep_selected(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that the classifier keeps, with the columns they came with; nulls, empty texts, repeats,
    empty tables and missing labels as in ``quality_classifier``."""
    df, score, cut = _graded(documents, labels, options)
    return df.filter(score["tail_probability"] >= cut)
