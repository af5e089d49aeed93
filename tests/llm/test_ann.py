import math

import numpy as np
import pyarrow.dataset as ds

from newsloom.llm import ann, common

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        at = np.flatnonzero(ids == q)[0]
        s = np.array([math.fsum(a * b for a, b in zip(x[at].tolist(), row.tolist(), strict=True)) for row in x]) if len(x) < 60 else x @ x[at]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_recall(spark):
    sf = "sf0.01"
    table = ds.dataset(f"/root/testdata/{sf}/embeddings.parquet").to_table()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float64)
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = by_query(ann.op5_ann(spark, f"/root/testdata/{sf}").collect())
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    scores = {q: dict(zip(ids.tolist(), (x @ x[np.flatnonzero(ids == q)[0]]).tolist(), strict=True)) for q in want}
    assert all(abs(s - scores[q][i]) < 1e-9 for q, v in got.items() for i, s in v)


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 5)).astype(np.float32)
    rows = [(i, base[i % 6].tolist(), "", "") for i in range(900, 1300)]
    rows += [(2000 + i, rng.normal(size=5).astype(np.float32).tolist(), "", "") for i in range(50)]
    good = list(rows)
    rows += [(1, None, "", ""), (2, [0.0] * 5, "", ""), (3, [1.0, None, 0.0, 0.0, 0.0], "", ""), (4, [float("nan")] * 5, "", ""), (20, [float("inf"), 0.0, 0.0, 0.0, 0.0], "", ""), (40, [], "", ""), (60, [1.0], "", ""), (None, [1.0] * 5, "", ""), rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = by_query(ann.search(df, df.where("vec_id % 20 = 0"), k=7, block=64).collect())
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good], np.float32).astype(np.float64)
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(got) == sorted(queries)
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = sorted((-round(v, 9), i) for v, i in zip(s, ids, strict=True) if i != q)[:7]
        assert [i for i, _ in got[q]] == [i for _, i in order]


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], "", ""), (1, [2.0, 1.0], "", ""), (20, [1.0, 0.0], "", "")], SCHEMA)
    got = by_query(ann.search(few, few.where("vec_id % 20 = 0")).collect())
    assert [i for i, _ in got[0]] == [1, 20] and [i for i, _ in got[20]] == [1, 0]
    assert ann.search(spark.createDataFrame([], SCHEMA), few).count() == 0


def test_anisotropic_loss_falls_and_beats_plain_codes():
    x = np.random.default_rng(2).normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain, aware = ann.fit(x, eta=1.0), ann.fit(x, eta=4.0)
    assert aware.loss(x, aware.encode(x)) < ann.Codebooks(plain.words, 4.0).loss(x, plain.encode(x))
    codes = aware.encode(x[:20])
    tables = aware.tables(x[:3])
    sums = np.array([[sum(t[m][b] for m, b in enumerate(row)) for row in aware.pair(codes)] for t in tables])
    assert np.allclose(sums, x[:3] @ aware.decode(codes).T, atol=1e-5)


def test_table(spark):
    assert common.table(spark, "/root/testdata/sf0.001", "embeddings").count() == 500


def test_ties_over_blocks_go_to_smaller_ids(spark):
    """Different vectors of one score, in any order, over one block and over several."""
    rng = np.random.default_rng(3)
    others = [(int(i), [1.0, *rng.normal(size=4).tolist()], "", "") for i in rng.permutation(np.arange(1, 400)) if i % 20]
    df = spark.createDataFrame([(20, [2.0, 0.0, 0.0, 0.0, 0.0], "", ""), *others], SCHEMA)
    for block in (8192, 50):
        got = by_query(ann.search(df, df.where("vec_id = 20"), k=5, block=block, rerank=400).collect())
        assert got[20] == [(i, 2.0) for i in (1, 2, 3, 4, 5)], block


def test_recall_over_blocks_with_little_reranking(spark):
    """Five blocks, of each of which under 5% is scored exactly."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9000, 32)).astype(np.float32) * rng.uniform(0.5, 1.5, (9000, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(x)], SCHEMA)
    got = by_query(ann.search(df, df.where("vec_id % 300 = 0"), block=1800, rerank=88).collect())
    want = exact(np.arange(len(x)), x.astype(np.float64), range(0, 9000, 300), 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))
