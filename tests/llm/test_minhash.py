import itertools
import random

import numpy as np
import pytest

from newsloom.llm import minhash

SCHEMA = "doc_id long, text string, sketch string, kept string"


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(k, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def variants(seed=1, families=12, size=14, length=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(length)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6, 9])):
                words[rng.randrange(length)] = rng.choice(vocab)
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k,tile", [(4, 1024), (5, 16)])
def test_equals_brute_force(spark, k, tile):
    rows = variants() + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (None, "one"), (3, "other words entirely here now ok"), (1005, "x " * 30000)]
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, k=k, tile=tile).collect()), key=str)
    assert got == brute(rows, k, 80)


@pytest.mark.parametrize("fine", [160, 640])
def test_small_tiles_find_every_link(spark, fine):
    rows = variants(seed=5, families=6)
    df = spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, k=5, fine=fine, tile=8).collect()), key=str)
    assert got == brute(rows, 5, 80)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_agreement_estimates_jaccard():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40, 5000):
        pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        a, b = pool[: n + n // 2], pool[n // 2 :]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sa, sb = minhash.sketch(a, 160), minhash.sketch(b, 160)
        assert abs((sa == sb).mean() - true) < 0.16
        assert (minhash.sketch(a, 160) == sa).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 502)], "a long, b long")
    got = dict(minhash.connected_components(edges).collect())
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500}
