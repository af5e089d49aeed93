"""Quality classifier: a generalised additive model with pairwise interactions (an explainable boosting machine).

Each feature has a table of log-odds over its bins, some pairs of features have a table over a grid of bins, and a
score is the logistic of the sum of table entries: a vectorised gather and add for each table. Tables are learned by
cyclic boosting: round after round, each feature in turn gets a shallow tree (three cuts at most) fitted to the gradient
of its bins and added with a small rate, so no feature takes what another explains. Then the pairs whose grid explains
most of the remaining gradient are boosted the same way with trees of one cut in each direction.

Features are taken from whole texts in one pass, on executors; fitting sees a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import common

FEATURES = [
    "log_chars", "log_words", "mean_word", "upper_share", "digit_share", "stop_share", "mark_share", "symbol_share", "bar_share",
    "space_share", "high_share", "distinct_share", "top_word_share", "repeat_share", "repeated_line_share", "log_mean_line", "shout_share", "odd_word_share",
]

_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in b".,;":
    _CLASS[_c] = 3
for _c in b"!?":
    _CLASS[_c] = 4
for _c in b"#$%&*@^~=+<>[]{}\\/_":
    _CLASS[_c] = 5
_CLASS[ord("|")] = 6
for _c in b" \t\n\r\x0b\x0c":
    _CLASS[_c] = 7
_CLASS[128:] = 8
_CLASS[ord("a") : ord("z") + 1] = 9

_PLAIN_WORD = re.compile(rb"[\"'(]*[A-Za-z\x80-\xff]+(?:['-][A-Za-z\x80-\xff]+)*[.,;:!?\"')]*")


def features(text: str | None) -> list[float]:
    """The features of one text, in the order of FEATURES; all 0 for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, byte, 10) / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = Counter(words)
    w = max(1, len(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    odd = sum(c for x, c in count.items() if not _PLAIN_WORD.fullmatch(x))
    shout = sum(c for x, c in count.items() if len(x) > 1 and x.isupper())
    return [
        np.log1p(n), np.log1p(len(words)), (n - share[7] * n) / w, share[1], share[2], share[3], share[4], share[5], share[6],
        share[7], share[8], len(count) / w, max(count.values(), default=0) / w, repeats / w,
        1 - len(set(lines)) / len(lines) if lines else 0.0, np.log1p(n / max(1, len(lines))), shout / w, odd / w,
    ]


class AdditiveModel:
    """Bin edges, tables of features and of pairs, and the intercept."""

    def __init__(self, edges: list[np.ndarray], pair_edges: list[np.ndarray], intercept: float, tables: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.edges, self.pair_edges, self.intercept, self.tables, self.pairs = edges, pair_edges, intercept, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "left")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], "left"), np.searchsorted(self.pair_edges[j], x[:, j], "left")]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between quantiles, each midway between two values that occur."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def _tree(grad: np.ndarray, hess: np.ndarray, least: float, cuts: int, damp: float = 1.0) -> np.ndarray:
    """Leaf values over ordered bins: greedy best cuts by gain, Newton steps in the leaves."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    leaves = [(0, len(grad))]
    for _ in range(cuts):
        best = (1e-9, None, None)
        for leaf in leaves:
            a, b = leaf
            k = np.arange(a + 1, b)
            if not len(k):
                continue
            gl, hl, gr, hr = g[k] - g[a], h[k] - h[a], g[b] - g[k], h[b] - h[k]
            gain = gl**2 / (hl + damp) + gr**2 / (hr + damp) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + damp)
            gain[(hl < least) | (hr < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), leaf, int(k[gain.argmax()]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in leaves:
        out[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + damp)
    return out


def _grid_tree(grad: np.ndarray, hess: np.ndarray, least: float, damp: float = 1.0) -> tuple[np.ndarray, float]:
    """Leaf values over a grid: the best pair of one cut in each direction (four leaves), and its gain."""
    g, h = (np.zeros((grad.shape[0] + 1, grad.shape[1] + 1)) for _ in range(2))
    g[1:, 1:], h[1:, 1:] = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    a, b = grad.shape
    if a < 2 or b < 2:
        return np.zeros_like(grad), 0.0
    gain = np.zeros((a - 1, b - 1))
    quads = []
    for rows in (0, 1):
        for cols in (0, 1):
            def corner(t: np.ndarray) -> np.ndarray:
                i = np.arange(1, a)[:, None]
                j = np.arange(1, b)[None, :]
                x = t[i, j] if not rows else t[a, j] - t[i, j]
                y = (t[i, b] if not rows else t[a, b] - t[i, b])
                return x if not cols else y - x
            gq, hq = corner(g), corner(h)
            quads.append((gq, hq))
            gain += np.where(hq >= least, gq**2 / (hq + damp), 0)
    gain -= g[a, b] ** 2 / (h[a, b] + damp)
    at = np.unravel_index(gain.argmax(), gain.shape)
    i, j = at[0] + 1, at[1] + 1
    out = np.zeros_like(grad)
    for (gq, hq), s in zip(quads, ((slice(0, i), slice(0, j)), (slice(0, i), slice(j, b)), (slice(i, a), slice(0, j)), (slice(i, a), slice(j, b))), strict=True):
        if hq[at] >= least:
            out[s] = -gq[at] / (hq[at] + damp)
    return out, float(gain[at])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.1, least: float = 2.0) -> AdditiveModel:
    """Boost the tables; with one label only, or none, the model is a constant."""
    k = x.shape[1]
    if not len(y):
        return AdditiveModel([np.empty(0)] * k, [np.empty(0)] * k, 0.0, [np.zeros(1)] * k, {})
    p = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(p / (1 - p)))
    edges, coarse = [_edges(x[:, j], bins) for j in range(k)], [_edges(x[:, j], pair_bins) for j in range(k)]
    at = [np.searchsorted(edges[j], x[:, j], "left") for j in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
        return q - y, np.maximum(q * (1 - q), 1e-6)

    if 0 < y.sum() < len(y):
        for _ in range(rounds):
            for j in range(k):
                if len(tables[j]) > 1:
                    grad, hess = gradient()
                    step = rate * _tree(np.bincount(at[j], grad, len(tables[j])), np.bincount(at[j], hess, len(tables[j])), 1e-3 * least, 3)
                    tables[j] += step
                    total += step[at[j]]
    grids: dict[tuple[int, int], np.ndarray] = {}
    if 0 < y.sum() < len(y):
        c = [np.searchsorted(coarse[j], x[:, j], "left") for j in range(k)]
        sizes = [len(e) + 1 for e in coarse]
        cell = lambda i, j: c[i] * sizes[j] + c[j]
        grad, hess = gradient()
        sums = lambda v, i, j: np.bincount(cell(i, j), v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
        gains = sorted(((_grid_tree(sums(grad, i, j), sums(hess, i, j), 1e-3 * least)[1], i, j) for i in range(k) for j in range(i + 1, k)), reverse=True)
        grids = {(i, j): np.zeros((sizes[i], sizes[j])) for gain, i, j in gains[:pairs] if gain > 0}
        for _ in range(pair_rounds):
            for (i, j), table in grids.items():
                grad, hess = gradient()
                step = rate * _grid_tree(sums(grad, i, j), sums(hess, i, j), 1e-3 * least)[0]
                table += step
                total += step[c[i], c[j]]
    return AdditiveModel(edges, coarse, intercept, tables, grids)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column(1).to_pylist()]
        flat = pa.array(np.array(rows, np.float64).reshape(-1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)), flat)], ["doc_id", "x"])


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the feature vector of each row's whole text."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_feature_batches, T.StructType([src.schema.fields[0], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def train(featured: DataFrame, labels: DataFrame, max_rows: int = 20_000, label_col: str = "quality", **options) -> AdditiveModel:
    """Fit on at most about ``max_rows`` labelled rows, drawn by a hash of the id (all, if there are fewer).

    Labels other than 0 and 1, and null ids, teach nothing. A doc_id labelled several times takes its largest label; of
    rows with one doc_id and different texts the least feature vector counts, whatever the order of the rows.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    rows = featured.groupBy("doc_id").agg(F.min("x").alias("x")).join(known, "doc_id")
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    got = rows.select("doc_id", "x", "y").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(np.float64), **options)


def score(featured: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, score, predicted of featured rows."""
    ref = featured.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = ref.value.score(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kinds = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return featured.select("doc_id", "x").mapInArrow(run, T.StructType([featured.schema["doc_id"], *kinds]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of two thirds of them."""
    featured = common.materialise(with_features(common.table(spark, sf_dir, "documents")), "features")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    learn = lambda df: df.where(common.crc_mod(F.col("doc_id"), 3) != 1)
    out = score(featured, train(learn(featured), learn(labels)))
    return out.select("doc_id", (common.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
