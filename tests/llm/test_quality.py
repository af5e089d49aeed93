import numpy as np
import pyarrow.dataset as ds

from newsloom.llm import quality

SCHEMA = "doc_id long, text string, x string, score string"


def test_features_of_odd_texts():
    for text in (None, "", " \n", "A", "a" * 500_000, "é", "!!! ???\n\n!!!"):
        row = quality.features(text)
        assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()
    at = dict(zip(quality.FEATURES, quality.features("GO go go!! 12 | x\nGO"), strict=True))
    assert at["upper_share"] == 4 / 20 and at["digit_share"] == 2 / 20 and at["bar_share"] == 1 / 20
    assert at["repeat_share"] == 0 and abs(at["distinct_share"] - 6 / 7) < 1e-12


def test_tables_find_main_effects_and_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 4))
    logit = 6 * (x[:, 0] > 0.6) - 3 + 8 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) - 4
    y = (rng.random(6000) < 1 / (1 + np.exp(-logit))).astype(float)
    model = quality.fit(x[:4000], y[:4000])
    assert (1, 2) in model.pairs
    p = model.score(x[4000:])
    assert ((p >= 0.5) == y[4000:]).mean() > 0.85
    plain = quality.fit(x[:4000], y[:4000], pairs=0)
    assert ((plain.score(x[4000:]) >= 0.5) == y[4000:]).mean() < 0.75


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3)).round(1)
    model = quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), rounds=20)
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.intercept
        for j in range(3):
            total += model.tables[j][sum(row[j] > e for e in model.edges[j])]
        for (i, j), t in model.pairs.items():
            total += t[sum(row[i] > e for e in model.pair_edges[i]), sum(row[j] > e for e in model.pair_edges[j])]
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-12


def test_tree_equals_exhaustive_first_cut():
    rng = np.random.default_rng(2)
    g, h = rng.normal(size=20), rng.random(20) + 0.1
    gains = [g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) for k in range(1, 20)]
    k = int(np.argmax(gains)) + 1
    out = quality._tree(g, h, 0.0, 1)
    assert len(set(out)) == 2 and np.flatnonzero(np.diff(out))[0] + 1 == k
    assert abs(out[0] + g[:k].sum() / (h[:k].sum() + 1)) < 1e-12


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.op3_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = ds.dataset("/root/testdata/sf0.01/labels.parquet").to_table().to_pylist()
    held = [r for r in labels if got[r["doc_id"]].held_out]
    assert len(got) == 1000 and np.mean([got[r["doc_id"]].predicted == r["quality"] for r in held]) > 0.95


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a", "b"), (None, "", "a", "b"), (2, "words here", "a", "b"), (2, "words here", "a", "b")], SCHEMA)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1), (9, 1), (2, 7)], "doc_id long, quality int")
    featured = quality.with_features(docs)
    out = quality.score(featured, quality.train(featured, labels)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score(featured, quality.train(featured, none)).collect()
    assert [r.score for r in out] == [0.5] * 4
    empty = quality.with_features(spark.createDataFrame([], SCHEMA))
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_rows_of_one_id_teach_alike_in_any_order(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(["good", "text", "!!!", "x"], 30))) for i in range(60)] + [(5, "another text"), (5, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    fitted = [quality.train(quality.with_features(spark.createDataFrame(r, "doc_id long, text string")), labels) for r in (rows, rows[::-1])]
    assert all(np.allclose(a, b) for a, b in zip(fitted[0].tables, fitted[1].tables, strict=True))
