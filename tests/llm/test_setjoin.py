import random

import numpy as np
import pandas as pd
import pytest

from newsloom.llm import common, setjoin
from newsloom.llm.minhash import WordHashes, shingle_hashes

SCHEMA = "doc_id long, text string, node string, region string, size string, keys string"


def shingles(text, k=3):
    words = common.words(text)
    n = min(k, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def plain(docs, k=3, percent=90):
    sets = [shingles(t, k) for _, t in docs]
    label, links = list(range(len(docs))), [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is None or docs[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for x, (doc_id, _) in zip(label, docs, strict=True):
        if doc_id is not None:
            least[x] = min(doc_id, least.get(x, doc_id))
    return sorted(((d, len(s), n, least.get(x)) for (d, _), s, n, x in zip(docs, sets, links, label, strict=True)), key=str)


def joined(spark, docs, partitions=4, **options):
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in docs], SCHEMA).repartition(partitions)
    return sorted((tuple(r) for r in setjoin.set_join(df, **options).select("doc_id", "n_shingles", "n_links", "component_id").collect()), key=str)


def altered(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def families(seed, groups, size, length, changes):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(*length))]
        out += [" ".join(altered(rng, base, rng.randrange(changes))) for _ in range(size)]
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


def test_linked_sets_share_a_key():
    rng = random.Random(1)
    begins, parts = setjoin.size_buckets(90)
    for n in [1, 2, 9, 10, 11, 19, 20, 37, 60, 150, 400, 3000]:
        for _ in range(20):
            x = {rng.getrandbits(64) for _ in range(n)}
            most = int(10 * 2 * n / 190)
            y = set(x)
            for _ in range(rng.randrange(most + 1)):
                if rng.random() < 0.5 and y:
                    y.remove(next(iter(y)))
                else:
                    y.add(rng.getrandbits(64))
            both = len(x & y)
            if 100 * both < 90 * (len(x) + len(y) - both):
                continue
            keys = []
            for s in (x, y):
                e = np.array(sorted(s), np.uint64)
                low, high = np.searchsorted(begins, [len(e), 100 * len(e) // 90], "right") - 1
                keys.append({int(v) for b in range(low, high + 1) for v in setjoin.part_keys(e, b, int(parts[b]))})
            assert keys[0] & keys[1]


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200)).astype(np.uint64)) for _ in range(60)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets[:25]] for a in sets])
    assert (setjoin.intersections(sets, sets[:25]) == want).all()
    assert setjoin.intersections(sets, []).shape == (60, 0)


@pytest.mark.parametrize("options", [{}, {"leaf": 8, "pivots": 4, "chunk": 16, "replicas": 50.0}, {"leaf": 8, "block": 16, "replicas": 0.0}, {"leaf": 20, "pivots": 6, "chunk": 30, "block": 40, "block_elements": 2000}])
def test_equals_all_pairs(spark, options):
    docs = families(7, 6, 40, (30, 200), 12)
    docs += [(1000 + i, t) for i, (_, t) in enumerate(docs[:30])]  # copies
    docs += [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE "), (2004, "one two"), (None, docs[0][1]), (3, docs[9][1]), (2005, " \t\n")]
    assert joined(spark, docs, **options) == plain(docs)


def test_regions_are_parted_where_pivots_tell_documents_apart(spark):
    """A chain of documents, each linked to the next only, is one region at first, and its ends are far apart."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(500)]
    docs = [(i, " ".join(words[i : i + 100])) for i in range(0, 400)]
    hashes = WordHashes()
    rows = [(1, bytes([i // 256, i % 256]) * 8, 1, True, len(x), x.tobytes()) for i, t in docs for x in [shingle_hashes(common.words(t), 3, hashes)]]
    members = spark.createDataFrame(rows, setjoin.MEMBER)
    parted, sized = setjoin.part(members, 90, leaf=50, pivots=16, chunk=100, replicas=6.0)
    homes = parted.where("home").groupBy("node").count().where("count <> 1").count()
    regions = sized.count()
    assert homes == 0 and regions > 8
    # Whatever is linked to a document is in the region where it is at home.
    at = parted.toPandas()
    where = {bytes(n): r for n, r, h in zip(at["node"], at["region"], at["home"], strict=True) if h}
    inside = {(bytes(n), r) for n, r in zip(at["node"], at["region"], strict=True)}
    for i in range(400):
        own = rows[i][1]
        assert all((rows[j][1], where[own]) in inside for j in range(max(0, i - 5), min(400, i + 6)))
    assert joined(spark, docs, leaf=50, pivots=16, replicas=6.0) == plain(docs)


def test_tiles_count_only_what_is_at_home():
    sets = [np.arange(10, dtype=np.uint64), np.arange(11, dtype=np.uint64), np.arange(10, dtype=np.uint64) + np.uint64(1)]
    tile = pd.DataFrame({"region": [1] * 3, "node": [b"a", b"b", b"c"], "weight": [1, 5, 2], "home": [True, False, False], "size": [10, 11, 10], "elements": [x.tobytes() for x in sets], "side": [2] * 3})
    got = setjoin.tile_links(tile, 90)
    assert got.values.tolist() == [[b"a", 5, b"a"], [b"b", 0, b"a"]]


def test_hot_group_very_long_text_and_empty_table(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**4)}" for _ in range(120)]
    docs = [(i, " ".join(altered(rng, base, 1 + i % 3))) for i in range(400)]
    long = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    docs += [(900, " ".join(long)), (901, " ".join(altered(rng, long, 900))), (902, " ".join(long[:50_000]))]
    assert joined(spark, docs, leaf=64, block=100, pivots=8) == plain(docs)
    assert joined(spark, [], partitions=1) == []


def test_the_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = setjoin.op11_jaccard(spark, "/root/testdata/sf0.001").select("doc_id", "n_shingles", "n_links", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
