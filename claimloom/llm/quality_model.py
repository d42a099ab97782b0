"""Quality classifier over document statistics.

Random Fourier features approximate a Gaussian kernel over the standardised
statistics. Each partition sums its part of the normal equations; the driver
solves them for ridge scores. Isotonic regression over a histogram of scores,
from a fold that the ridge did not see, turns them into calibrated scores.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util

#: Frequent words of four languages, lower-cased.
FREQUENT = frozenset(
    b"the of and to in a is that for it as was with be by on are at this or de la le et les des en un du une que est pour qui dans par sur"
    b" der die und den von zu das mit sich auf el y los se del las por con no su al".split()
)
STATISTICS = [
    "log_words", "log_chars", "word_length", "upper", "lower", "digit", "mark", "symbol", "space", "line_ends", "wide", "distinct_words",
    "repeated_lines", "words_with_symbol", "frequent_words", "entropy", "bare_marks", "shouting",
]
FEATURES, RIDGE, BINS, SEED = 256, 1e-3, 1024, 29
#: Labelled rows that a fit uses at most; a hash of the id picks them beyond it.
MAX_LABELLED = 200_000
#: Partitions that sum normal equations; each sends one matrix.
SUMS = 8
HELD_OUT = 5

_SYMBOLS = b"#*$%&|<>"


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all zero without text."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256).astype(float)
    n = float(len(data))
    lead = n - counts[0x80:0xC0].sum()  # code points
    words = data.split()
    n_words = max(1, len(words))
    symbol = sum(counts[c] for c in _SYMBOLS)
    mark = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum() - symbol
    share = counts[counts > 0] / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = set(words)
    odd = bare = loud = 0
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    frequent = 0
    for w, k in tally.items():
        if w[-1] in b"#*$%&|<>!" or w[0] in b"#*$%&|<>!":
            odd += k
            bare += k * (len(w) == 1)
        if len(w) > 1 and w.isupper():
            loud += k
        if w.lower() in FREQUENT:
            frequent += k
    letters = max(1.0, counts[65:91].sum() + counts[97:123].sum())
    return [
        math.log1p(len(words)), math.log1p(lead), min(50.0, lead / n_words), counts[65:91].sum() / letters, counts[97:123].sum() / n, counts[48:58].sum() / n,
        mark / n, symbol / n, counts[32] / n, counts[10] / n, counts[0xC0:].sum() / lead if lead else 0.0, len(distinct) / n_words,
        1 - len(set(lines)) / max(1, len(lines)), odd / n_words, frequent / n_words, float(-(share * np.log2(share)).sum()), bare / n_words, loud / n_words,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and the statistics of each document."""
    schema = "doc_id bigint, held_out boolean, fold int, x array<float>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column(0).to_pylist()
                crc = [zlib.crc32(str(i).encode()) if i is not None else 0 for i in ids]
                x = np.array([statistics(t) for t in part.column(1).to_pylist()], dtype="float32").reshape(len(ids), len(STATISTICS))
                ends = pa.array(np.arange(len(ids) + 1, dtype="int32") * len(STATISTICS))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([c % HELD_OUT == 0 for c in crc]), pa.array([c // HELD_OUT % HELD_OUT for c in crc], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))],
                    names=["doc_id", "held_out", "fold", "x"],
                )

    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, len(STATISTICS))


def _sums(rows: DataFrame, function, length: int) -> np.ndarray:
    """Sum over partitions of the vectors that ``function(x, y)`` gives for each batch."""

    def run(batches):
        total = np.zeros(length)
        for b in batches:
            total += function(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = rows.select("x", "y").coalesce(SUMS).mapInArrow(run, "s array<double>").collect()  # SUMS vectors of fixed length
    return np.sum([np.array(r["s"]) for r in parts], axis=0) if parts else np.zeros(length)


class Model:
    """Means and scales, random features, ridge weights, calibration."""

    def __init__(self, features: int = FEATURES, seed: int = SEED, width: float = 1.0):
        rng = np.random.default_rng(seed)
        d = len(STATISTICS)
        self.w = rng.normal(size=(d, features)) / (width * math.sqrt(d))
        self.b = rng.uniform(0, 2 * math.pi, size=features)
        self.mean, self.scale = np.zeros(d), np.ones(d)
        self.beta = np.zeros(features + 1)
        self.at, self.level = np.array([0.0, 1.0]), np.array([0.5, 0.5])
        self.fitted = False

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b)), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth comes from the ridge score, so that steps of the calibration keep its order."""
        if not self.fitted:
            return np.full(len(x), 0.5)
        raw = self.ridge(x)
        smooth = 1 / (1 + np.exp(-4 * np.clip(raw - 0.5, -5, 5)))
        return np.clip(0.999 * np.interp(raw, self.at, self.level) + 0.001 * smooth, 0, 1)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Nondecreasing least-squares fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(y, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on rows (doc_id, fold, x, y); fold 0 calibrates, the others fit the ridge.

    Without labelled rows every score is one half.
    """
    total = labelled.count()
    if total > max_labelled:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / total))
    model, d = Model(), len(STATISTICS)
    train = labelled.filter("fold != 0")
    s = _sums(train, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    if not s[0]:
        return model
    model.fitted = True
    model.mean = s[1 : d + 1] / s[0]
    model.scale = np.sqrt(np.maximum(s[d + 1 :] / s[0] - model.mean**2, 1e-8)) + 1e-4
    k = len(model.beta)

    def normal(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    s = _sums(train, normal, k * k + k)
    gram, right = s[: k * k].reshape(k, k), s[k * k :]
    penalty = RIDGE * max(1.0, gram.trace() / k) * np.eye(k)
    penalty[-1, -1] = 0
    model.beta = np.linalg.solve(gram + penalty + 1e-9 * np.eye(k), right)

    low, high = -0.5, 1.5
    edges = np.linspace(low, high, BINS + 1)

    def histogram(x, y):
        at = np.clip(((model.ridge(x) - low) / (high - low) * BINS).astype(int), 0, BINS - 1) if len(x) else np.zeros(0, int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    s = _sums(labelled.filter("fold = 0"), histogram, 2 * BINS)
    n, ones = s[:BINS], s[BINS:]
    full = n > 0
    centre = (edges[:-1] + edges[1:]) / 2
    if full.any():
        model.at, model.level = centre[full], isotonic(ones[full] / n[full], n[full])
    else:
        model.at, model.level = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(measured: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    schema = "doc_id bigint, held_out boolean, score double, predicted int"

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    return measured.select("doc_id", "held_out", "x").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labelled documents that are not held out. Rows with a null id or
    label are not learned from; a document with several label rows counts once
    for each. Null and empty texts are scored as texts without statistics; very
    long texts are taken whole; repeated rows stay, and ties in score too; empty
    tables give no rows; other columns of either table are ignored.
    """
    measured = util.stored(with_statistics(docs), "statistics")
    y = labels.select("doc_id", F.col("quality").cast("double").alias("y")).dropna()
    labelled = util.stored(measured.filter(~F.col("held_out")).join(y, "doc_id").select("doc_id", "fold", "x", "y"), "labelled")
    return score(measured, fit(labelled), threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(util.table(spark, sf_dir, "documents"), util.table(spark, sf_dir, "labels"))
