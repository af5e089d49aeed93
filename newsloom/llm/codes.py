"""Vector code compression: product codes with integer codebooks, learned by tree aggregation over columnar blocks.

A component x becomes the integer floor(256 * x); a vector is cut into equal consecutive parts, and each part is coded by
the index of the nearest entry of its own codebook. Tasks turn their rows into blocks of a bounded size, one NumPy array
for each with a row for each dimension. A round sends the codebooks out (their size doesn't depend on the data), adds up
distances dimension by dimension, and counts and sums the members of each entry with ``np.add.at``; the int64 tensors meet
in ``RDD.treeAggregate``, so that the driver gets a few of them, however many blocks there are. All arithmetic is exact,
so neither partitions nor lost executors change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

#: Components at or beyond this magnitude can't be coded: sums of squares would leave 64 bits.
LIMIT = float(1 << 19)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (array<double>), and of a column ``label`` its values: rows whose vector is whole and finite."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int")
    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), v.alias("vector"))
    return out.where("vector is not null and size(vector) > 0").where(F.forall("vector", lambda x: F.coalesce(F.abs(x) < LIMIT, F.lit(False)) & ~F.isnan(x)))


def _blocks(dims: int, block: int):
    """(vec_id, vector) -> blocks: their ids and integers, one dimension after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
                whole = np.floor(flat * 256.0).astype(np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([np.ascontiguousarray(whole).tobytes()], pa.binary())], ["n", "data"])

    return run


def _padded(whole: np.ndarray, parts: int) -> np.ndarray:
    """(dimensions, rows) -> (parts, dimensions of a part, rows); short last parts are filled with zeros."""
    width = -(-whole.shape[0] // parts)
    out = np.zeros((parts * width, whole.shape[1]), np.int64)
    out[: whole.shape[0]] = whole
    return out.reshape(parts, width, -1)


def assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, width, rows) and (parts, entries, width) -> nearest entries and their squared distances, (parts, rows)."""
    codes = np.empty((block.shape[0], block.shape[2]), np.int64)
    errors = np.empty_like(codes)
    for p in range(block.shape[0]):
        far = np.zeros((block.shape[2], books.shape[1]), np.int64)
        for d in range(block.shape[1]):
            gap = block[p, d][:, None] - books[p, :, d][None, :]
            far += gap * gap
        codes[p] = far.argmin(1)  # of equals the first
        errors[p] = np.take_along_axis(far, codes[p][:, None], 1)[:, 0]
    return codes, errors


def learn(vectors: DataFrame, first: np.ndarray, dims: int, parts: int, rounds: int, block: int) -> np.ndarray:
    """Codebooks (parts, entries, width) after ``rounds`` of assigning all ``vectors`` and averaging."""
    context = vectors.sparkSession.sparkContext
    blocks = common.materialise(vectors.select("vec_id", "vector").mapInArrow(_blocks(dims, block), "n int, data binary"), "code-blocks")
    books = first
    for _ in range(rounds):
        sent = context.broadcast(books)

        def add(acc: tuple[np.ndarray, np.ndarray] | None, row) -> tuple[np.ndarray, np.ndarray]:
            own = sent.value
            sums, counts = acc or (np.zeros(own.shape, np.int64), np.zeros(own.shape[:2], np.int64))
            x = _padded(np.frombuffer(row.data, np.int64).reshape(dims, row.n), parts)
            codes, _ = assign(x, own)
            for p in range(parts):
                np.add.at(counts[p], codes[p], 1)
                np.add.at(sums[p], codes[p], x[p].T)
            return sums, counts

        def merge(a, b):
            return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

        got = blocks.rdd.treeAggregate(None, add, merge, depth=3)
        if got is not None:
            sums, counts = got
            books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        sent.unpersist()
    common.release(blocks)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """vec_id, label, code, error for each row of ``vectors``."""
    parts = books.shape[0]
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            codes, errors = assign(_padded(np.floor(flat * 256.0).astype(np.int64).T, parts), books)
            names = [bytes(c).hex() for c in codes.T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(errors.sum(0), pa.int64())], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2048) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row that can be coded.

    ``entries`` (at most 256) vectors of least id are the first codebooks; of rows that repeat an id the lesser vector
    comes first, rows without an id come last, and fewer rows make fewer entries. Rows whose vector is null or empty,
    holds a null, a non-finite component or one of 2**19 or more in magnitude, or has another length than the row of least
    id, are dropped. If the length can't be cut into equal parts, the last parts are filled with zeros. Repeated rows are
    coded each. Ties go to the lower entry. ``label_error`` is the error summed over equal labels, null labels (or a table
    without the column ``label``) together. Other columns are ignored, whatever their names. An empty table gives none.
    """
    kept = usable(rows, id_col, vector_col)
    first = kept.select(F.col("vec_id").isNull().alias("last"), "vec_id", "vector").orderBy("last", "vec_id", "vector").limit(1).collect()
    if not first:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dims = len(first[0].vector)
    kept = common.materialise(kept.where(F.size("vector") == dims), "code-vectors")
    least = kept.select(F.col("vec_id").isNull().alias("last"), "vec_id", "vector").orderBy("last", "vec_id", "vector").limit(entries).collect()
    start = np.floor(np.array([r.vector for r in least], np.float64) * 256.0).astype(np.int64).T
    books = learn(kept, _padded(start, parts).transpose(0, 2, 1).copy(), dims, parts, rounds, block)
    coded = common.materialise(encode(kept, books, dims), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` as 16 codes of 64 entries each."""
    return compress(common.table(spark, sf_dir, "embeddings"))


def _round_sql(k: int) -> str:
    return f"""
near{k} AS (
  SELECT x.vec_id, x.part, min(struct_pack(far := list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry := b.entry)) AS best
  FROM parts x JOIN book{k} b USING (part) GROUP BY x.vec_id, x.part),
"""


def _book_sql(k: int) -> str:
    return f"""
mean{k} AS (
  SELECT part, entry, list(m ORDER BY d) AS v FROM (
    SELECT x.part, n.best.entry AS entry, d, floor(sum(x.v[d])::DOUBLE / count(*))::BIGINT AS m
    FROM parts x JOIN near{k} n USING (vec_id, part), range(1, 5) r(d) GROUP BY x.part, n.best.entry, d) GROUP BY part, entry),
book{k + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry)),
"""


#: The same in DuckDB, for vectors of 64 components and ids that don't repeat.
OP13_SQL = (
    """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS (SELECT vec_id, part, q[4 * part + 1 : 4 * part + 4] AS v FROM kept, range(16) r(part)),
book0 AS (
  SELECT part, e.entry, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64) e USING (vec_id)),
"""
    + "".join(_round_sql(k) + (_book_sql(k) if k < 2 else "") for k in range(3))
    + """
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS s FROM book2),
coded AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), sha
"""
)
