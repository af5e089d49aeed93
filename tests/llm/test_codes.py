import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, n int"


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error), and the codebooks' digest, one vector and entry at a time."""
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[1]))
    q = [[math.floor(256 * x) for x in r[1]] for r in kept]
    w = len(q[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in q]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[nearest(v[p], books[p])[1]].append(v[p])
            for i, members in own.items():
                books[p][i] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out, by_label = [], defaultdict(int)
    for r, v in zip(kept, cut, strict=True):
        best = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), r[2]))
        by_label[r[2]] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, by_label[label], digest) for i, c, e, label in out)


def rows_of(found):
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_the_plain_version(spark, partitions):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.normal(0, 1, 32), 2).tolist(), int(rng.integers(3)) if i % 7 else None, "", 0) for i in range(300)]
    rows += [(300 + i, list(rows[i % 5][1]), 1, "", 0) for i in range(20)]  # repeated vectors
    rows += [(400, None, 1, "", 0), (401, [float("nan")] * 32, 1, "", 0), (402, [*rows[0][1][:31], None], 1, "", 0), (403, [float("inf"), *rows[0][1][1:]], None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = rows_of(codes.compress(df, block=50))
    assert got == plain(rows)
    assert codes.compress(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_negative_sums_are_floored_and_unused_entries_stay(spark):
    rows = [(i, [-(i + 1) / 256 / 3] * 16, None, "", 0) for i in range(9)] + [(9, [50.0] * 16, 4, "", 0)]
    assert rows_of(codes.compress(spark.createDataFrame(rows, SCHEMA), entries=4)) == plain(rows, entries=4)


def test_few_odd_and_no_rows(spark):
    assert rows_of(codes.compress(spark.createDataFrame([], SCHEMA))) == []
    assert rows_of(codes.compress(spark.createDataFrame([(1, None, 1, "", 0), (2, [], 1, "", 0)], SCHEMA))) == []
    # Another length than that of the least id, a component beyond the limit, a repeated id, no id, no column ``label``.
    rows = [(1, [1.0] * 20, 0, "", 0), (2, [1.0] * 16, 0, "", 0), (3, [1e9] + [0.0] * 19, 0, "", 0), (1, [0.5] * 20, 0, "", 0), (None, [2.0] * 20, 0, "", 0)]
    found = rows_of(codes.compress(spark.createDataFrame(rows, SCHEMA).drop("label").where("vec_id = 1 or vec_id in (2, 3)")))
    assert [r[0] for r in found] == [1, 1] and [r[2] for r in found] == [0, 0]
    # Twenty components make parts of two; the last six are zeros.
    assert {r[1] for r in found} == {"00" * 16, "01" * 10 + "00" * 6}
    with_none = codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.code[:2]) for r in with_none) == [(False, "00"), (False, "01"), (True, "02")]


def test_the_query_does_not_depend_on_layout(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    one, many = rows_of(codes.compress(df.repartition(1))), rows_of(codes.compress(df.repartition(8), block=64))
    assert one == many and len(one) == 500
