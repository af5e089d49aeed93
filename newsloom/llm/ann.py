"""Approximate nearest neighbours by inner product: score-aware quantisation, four-bit table scans, exact reranking.

Quantisation (Guo et al. 2020, "Accelerating Large-Scale Inference with Anisotropic Vector Quantization"): for large
inner products the part of the residual along the vector costs more than the part across it. With eta their ratio, a
vector's loss is  |r|^2 + (eta - 1) (r . x / |x|)^2. Product codebooks of 16 words for each pair of dimensions are
trained by turns: codes by coordinate descent on that loss, then the words of one subspace after another. Four-bit
codes of neighbouring subspaces share a byte.

Search. Equal vectors are one class with its least ids, so copies cannot fill a list. Queries and data are dealt into
blocks; a task scans one block of codes for one block of queries with byte tables (two subspaces at a time), takes the
best ``rerank`` of the block for each query, and scores them exactly on the original vectors in double precision. What
leaves a task are ``k`` classes a query, and a window keeps the best over the blocks. Memory is bounded by the blocks.
The data are sent once for each block of ``query_block`` queries. The space isn't partitioned: on directions without
clusters a probe of half the cells finds nine in ten (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import common

WORDS = 16


class Codebooks:
    """For each subspace of ``width`` dimensions 16 words; ``eta`` weighs the parallel residual."""

    def __init__(self, words: np.ndarray, eta: float):
        self.words, self.eta = words, eta
        self.spaces, _, self.width = words.shape

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (vectors x subspaces): the nearest words, then coordinate descent on the anisotropic loss."""
        parts = x.reshape(len(x), self.spaces, self.width)
        codes = np.empty((len(x), self.spaces), np.uint8)
        for m in range(self.spaces):
            codes[:, m] = ((parts[:, m, None, :] - self.words[m][None]) ** 2).sum(2).argmin(1)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        dirs = unit.reshape(parts.shape)
        along = np.empty((len(x), self.spaces))
        for m in range(self.spaces):
            along[:, m] = ((parts[:, m] - self.words[m][codes[:, m]]) * dirs[:, m]).sum(1)
        whole = along.sum(1)
        for _ in range(rounds):
            for m in range(self.spaces):
                r = parts[:, m, None, :] - self.words[m][None]
                a = (r * dirs[:, m, None, :]).sum(2)
                loss = (r * r).sum(2) + (self.eta - 1) * (whole[:, None] - along[:, m, None] + a) ** 2
                codes[:, m] = loss.argmin(1)
                new = a[np.arange(len(x)), codes[:, m]]
                whole += new - along[:, m]
                along[:, m] = new
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.words[m][codes[:, m]] for m in range(self.spaces)], axis=1)

    def loss(self, x: np.ndarray, codes: np.ndarray) -> float:
        r = x - self.decode(codes)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return float(((r * r).sum(1) + (self.eta - 1) * (r * unit).sum(1) ** 2).mean())

    def pair(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte; an odd last subspace stands alone."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of queries with pairs of words: queries x pairs x 256."""
        parts = queries.reshape(len(queries), self.spaces, self.width)
        single = np.einsum("qmw,mkw->qmk", parts, self.words)
        if self.spaces % 2:
            single = np.concatenate([single, np.zeros((len(queries), 1, WORDS))], axis=1)
        low, high = single[:, 0::2], single[:, 1::2]
        return (low[:, :, None, :] + high[:, :, :, None]).reshape(len(queries), -1, WORDS * WORDS).astype(np.float32)


def threshold_eta(dims: int, share: float = 0.2) -> float:
    """The ratio of weights for inner products above ``share`` of the norm: (d - 1) s^2 / (1 - s^2), 1 at least."""
    return max(1.0, (dims - 1) * share**2 / (1 - share**2))


def fit(x: np.ndarray, width: int = 2, rounds: int = 6, eta: float | None = None, seed: int = 0) -> Codebooks:
    """Codebooks of a sample; dimensions that ``width`` does not divide are padded with zeros by the caller."""
    rng = np.random.default_rng(seed)
    spaces, n = x.shape[1] // width, len(x)
    eta = threshold_eta(x.shape[1]) if eta is None else eta
    words = np.empty((spaces, WORDS, width))
    for m in range(spaces):  # plain k-means to begin with
        part = x[:, m * width : (m + 1) * width]
        centre = part[rng.choice(n, WORDS, replace=n < WORDS)] + 1e-6 * rng.normal(size=(WORDS, width))
        for _ in range(8):
            near = ((part[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            for k in range(WORDS):
                if (own := near == k).any():
                    centre[k] = part[own].mean(0)
        words[m] = centre
    books = Codebooks(words, eta)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for _ in range(rounds):
        codes = books.encode(x)
        parts, dirs = x.reshape(n, spaces, width), unit.reshape(n, spaces, width)
        whole = ((x - books.decode(codes)) * unit).sum(1)
        for m in range(spaces):  # the words of one subspace, the others as they are: a small system for each word
            u, p, old = dirs[:, m], parts[:, m], words[m][codes[:, m]]
            rest = whole - ((p - old) * u).sum(1)
            for k in range(WORDS):
                if (own := codes[:, m] == k).any():
                    a = own.sum() * np.eye(width) + (eta - 1) * u[own].T @ u[own]
                    b = p[own].sum(0) + (eta - 1) * u[own].T @ ((u[own] * p[own]).sum(1) + rest[own])
                    words[m, k] = np.linalg.solve(a, b)
            whole = rest + ((p - words[m][codes[:, m]]) * u).sum(1)
    return books


def scan(tables: np.ndarray, codes: np.ndarray, top: int) -> np.ndarray:
    """For each query the ``top`` rows with the largest table sums, of equal sums the first; rows are codes in bytes."""
    top = min(top, len(codes))
    out = np.empty((len(tables), top), np.int64)
    columns = np.ascontiguousarray(codes.T)
    total = np.empty(len(codes), np.float32)
    for q, table in enumerate(tables):
        np.take(table[0], columns[0], out=total)
        for m in range(1, len(columns)):
            total += table[m][columns[m]]
        if top == len(codes):
            out[q] = np.arange(top)
            continue
        least = np.partition(total, len(codes) - top)[len(codes) - top]
        above = np.flatnonzero(total > least)
        out[q] = np.concatenate([above, np.flatnonzero(total == least)[: top - len(above)]])
    return out


def _search_block(books_ref, k: int, rerank: int, pad: int):
    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "q_class", "class", "score", "ids"]
        if not len(q) or not len(d):
            return pd.DataFrame({c: [] for c in names})
        books: Codebooks = books_ref.value
        d = d.iloc[np.argsort(d["ids"].str[0].to_numpy(np.int64), kind="stable")]  # ties go to smaller ids
        x, y = (np.array(df.tolist(), np.float64) for df in (q["q_vector"], d["vector"]))
        wide = lambda m: np.pad(m, ((0, 0), (0, pad))) if pad else m
        codes = books.pair(np.array([np.frombuffer(c, np.uint8) for c in d["codes"]]))
        rows = []
        ids, classes, own, listed = d["ids"].to_numpy(), d["class"].to_numpy(), q["q_class"].to_numpy(), q["query_id"].to_numpy()
        for i in range(0, len(x), 256):
            best = scan(books.tables(wide(x[i : i + 256])), codes, rerank)
            exact = np.einsum("qd,qrd->qr", x[i : i + 256], y[best])
            order = np.lexsort((best, -exact), axis=1)[:, : k + 1]
            for j in range(len(best)):
                at = best[j][order[j]]
                rows += [(listed[i + j], own[i + j], classes[a], s, ids[a]) for a, s in zip(at, exact[j][order[j]], strict=True)]
        return pd.DataFrame(rows, columns=names)

    return run


def _encode(books_ref, pad: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["vector"].tolist(), np.float64).reshape(len(pdf), -1)
            codes = books_ref.value.encode(np.pad(x, ((0, 0), (0, pad)))) if len(pdf) else np.empty((0, 1), np.uint8)
            yield pdf.assign(codes=[c.tobytes() for c in codes])

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    sample: int = 8000,
    width: int = 2,
    rerank: int = 400,
    block: int = 8192,
    query_block: int = 16384,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` rows with the largest inner products found, but its own.

    Codebooks are fitted to about ``sample`` classes of equal vectors, drawn by hash; every class is indexed. Vectors
    that are null, zero, or hold null or non-finite components take no part, nor do those whose length is not that of
    most; a row without id takes no part. Rows equal in id and vector are one. Of equal scores the smaller id comes
    first. A query is a row of ``queries`` (same columns). Other columns are ignored. An empty table gives none.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"

    # Vectors travel as they are stored, and are widened to double where they are multiplied.
    stored = {df.schema[vector_col].dataType.simpleString() for df in (vectors, queries)}
    kind = "array<float>" if stored == {"array<float>"} else "array<double>"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast(kind)
        df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where("id is not null and vector is not null and size(vector) > 0")
        good = ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        return df.where(F.coalesce(good, F.lit(False)) & F.exists("vector", lambda c: c != 0))

    rows = usable(vectors)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims = sizes.d
    pad = -dims % width
    # A class holds the k + 1 least ids of its vector: one may be the query itself. The row limit of the window is
    # applied before its shuffle, too, so a vector that many rows share sends a few rows from each task.
    keyed = rows.where(F.size("vector") == dims).withColumn("class", F.xxhash64("vector")).dropDuplicates(["id", "class"])
    first = keyed.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("place") <= k + 1)
    classes = common.materialise(first.groupBy("class").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector")), "ann-classes")
    n = classes.count()
    few = classes.where(F.pmod(F.xxhash64("class", F.lit(5)), F.lit(1 << 20)) < max(1, min(1 << 20, int(sample / n * (1 << 20)) + 1))).select("vector").toPandas()
    if not len(few):
        few = classes.select("vector").limit(sample).toPandas()
    x = np.pad(np.array(few["vector"].tolist(), np.float64), ((0, 0), (0, pad)))
    books = spark.sparkContext.broadcast(fit(x, width))
    coded = classes.mapInPandas(_encode(books, pad), f"class long, ids array<long>, vector {kind}, codes binary")
    asked = usable(queries).where(F.size("vector") == dims).withColumn("q_class", F.xxhash64("vector")).dropDuplicates(["id", "q_class"]).select(F.col("id").alias("query_id"), "q_class", F.col("vector").alias("q_vector"))
    asked = common.materialise(asked, "ann-queries")
    db, qb = max(1, -(-n // block)), max(1, -(-asked.count() // query_block))
    deal = lambda df, key, n, name: df.withColumn(name, F.pmod(F.xxhash64(key, F.lit(9)), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = deal(asked, "query_id", qb, "qb").withColumn("qd", every(db))
    right = deal(coded, "class", db, "db").withColumn("dq", every(qb))
    # A query's own class may take one of its places, and all others have one id at least: k + 1 classes suffice.
    found = left.groupBy("qb", "qd").cogroup(right.groupBy("dq", "db")).applyInPandas(_search_block(books, k, max(rerank, k + 1), pad), "query_id long, q_class long, class long, score double, ids array<long>")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "q_class").orderBy(F.desc("score"), F.element_at("ids", 1)))).where(F.col("place") <= k + 1)
    each = best.select("query_id", "q_class", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_class").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20, among all ``embeddings``."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
