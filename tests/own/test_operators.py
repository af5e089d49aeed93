import dataclasses
import datetime as dt
import itertools
import json
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as text_functions
from newsloom.operators import dimensions, duplicates, geocode, graph, listing, location, scoring, summaries
from newsloom.plans import queries
from newsloom.profiles import TURKISH, Profile, Rule
from newsloom.sources import pages, snapshots, specs


# --- scoring ---


def scored(spark, rows, lexicon, profile=TURKISH, **columns):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, title string, body string, url string")
    lex = spark.createDataFrame(lexicon, "category string, keyword string, weight int")
    return docs, lex, scoring.keyword_hits(docs, lex, profile)


def test_keyword_counts(spark):
    rows = [("", "kaza kazası xkaza", ""), ("", "kaza" + "a" * 8 + " kaza" + "a" * 9, ""), ("", "kesinti kesintisi kesintisiz", ""), ("kaza", "KAZA kaza, kaza", ""), ("", "yangın çıktı yangın  çıktı yangın, çıktı", "")]
    lexicon = [("T", "kaza", 5), ("E", "kesinti", 3), ("Y", "yangın çıktı", 4), ("Y", "SEDAS", 4), ("Y", "sedas", 4)]
    got = {(r.id, r.keyword): (r.n_title, r.n_body) for r in scored(spark, rows, lexicon)[2].collect()}
    assert got == {(0, "kaza"): (0, 2), (1, "kaza"): (0, 1), (2, "kesinti"): (0, 2), (3, "kaza"): (1, 3), (4, "yangın çıktı"): (0, 1)}


def test_keys_that_differ_in_writing_add_up(spark):
    _, _, hits = scored(spark, [("", "sedas", "")], [("Y", "SEDAS", 4), ("Y", "sedas", 4)])
    assert scoring.keyword_scores(hits, TURKISH).collect()[0].score == 8


@pytest.mark.parametrize("weight,category", [(7, None), (8, "Trafik Kazasi")])
def test_threshold(spark, weight, category):
    docs, lex, _ = scored(spark, [("", "kaza", "")], [("Trafik Kazasi", "kaza", weight)])
    assert scoring.classify(docs, lex, TURKISH).collect()[0].category == category


def test_ties_rules_and_resets(spark):
    rules = (Rule("fire out", ("duman",), (("Yangin", -30),), must_not=("alev",)), Rule("reset", ("sanayi",), reset=("Trafik Kazasi",)), Rule("a", ("bir",), (("Yangin", 9),), group="x"), Rule("b", ("bir|iki",), (("Yangin", 20),), group="x"))
    profile = Profile(categories=("Trafik Kazasi", "Yangin"), rules=rules)
    rows = [("", "kaza yangın", ""), ("", "kaza yangın duman", ""), ("", "yangın duman alev", ""), ("", "kaza sanayi", ""), ("", "bir iki", ""), ("", "iki", ""), (None, None, None)]
    docs, lex, _ = scored(spark, rows, [("Trafik Kazasi", "kaza", 10), ("Yangin", "yangın", 10)], profile)
    got = {r.id: (r.category, r.score) for r in scoring.classify(docs, lex, profile).collect()}
    assert got == {0: ("Trafik Kazasi", 10), 1: ("Trafik Kazasi", 10), 2: ("Yangin", 10), 3: (None, 0), 4: ("Yangin", 9), 5: ("Yangin", 20), 6: (None, 0)}


def test_bonus_rounds_half_to_even(spark):
    profile = Profile(categories=("a", "b"), threshold=1)
    docs, lex, _ = scored(spark, [("", "x", "")], [("a", "y", 1)], profile)
    bonus = spark.createDataFrame([(0, "a", 0.25), (0, "b", 0.35)], "id int, category string, similarity double")
    r = scoring.classify(docs, lex, profile, bonus, 10).collect()[0]
    assert (r.score_0, r.score_1) == (2, 4)


# --- places ---


def located(spark, rows, gazetteer=None, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, title string, body string, category string")
    names = gazetteer and spark.createDataFrame(gazetteer, "name string, district string")
    return {r.id: r for r in location.extract_location(df, TURKISH, names, category_col="category", **options).collect()}


def test_compose(spark):
    rows = [
        ("Gebze'de kaza", "Sultan Orhan Mahallesi'nde iki araç çarpıştı", None), ("Darıca", "olay", None), ("Kaza", "Kocaeli genelinde", None), ("İstanbul'da kaza", "bir olay", "Yangin"),
        ("Kaza", "bir olay", None), ("Kaza", "bir olay", "Yangin"), ("Kaza", "bursa ve bursa", None), ("Kaza", "Olay kentte oldu", None), (None, None, None),
    ]
    got = located(spark, rows)
    assert got[0].district == "Gebze" and got[0].location_text.endswith("Mahallesi, Gebze, Kocaeli") and got[0].geocode_query.endswith(", Türkiye")
    assert got[1].location_text == "Darica, Kocaeli" and not got[1].geocode_fallback
    assert got[2].location_text == "Kocaeli" and got[2].geocode_fallback
    assert [got[i].location_text for i in (3, 4, 6, 8)] == [None] * 4
    assert got[5].location_text == got[7].location_text == "Kocaeli"


def test_gazetteer_and_ties(spark):
    got = located(spark, [("x", "yuvacık tarafında", None), ("x", "gebze darıca", None)], [("Yuvacık", "Basiskele")])
    assert got[0].district == "Basiskele" and got[1].district == "Gebze"


def test_district_scores(spark):
    df = spark.createDataFrame([(1, "gebze", "gebzede gebze", "http://x/gebze/1")], "doc_id int, title string, body string, url string")
    r = location.district_scores(df, TURKISH, url_col="url").collect()
    assert [(x.district, x.score) for x in r] == [("Gebze", 100 + 3 + 35 + 20)]


# --- duplicates ---


def test_find_duplicate(spark):
    unit = lambda c: [c, (1 - c * c) ** 0.5]
    case = lambda kept, same: duplicates.find_duplicate(spark.createDataFrame([("n", 99, "A", [1.0, 0.0])], "id string, ord long, category string, embedding array<double>"), spark.createDataFrame([(str(i), i, c, unit(s)) for i, (s, c) in enumerate(kept)], "id string, ord long, category string, embedding array<double>")).collect()[0].match
    assert case([(0.85, "B"), (0.83, "A")], None) is None
    assert [case([(s, c)], None) for s, c in ((0.81, "A"), (0.81, "B"), (0.881, "B"), (0.8, "A"))] == ["0", None, "0", None]
    assert case([(0.9, "B"), (0.9, "B")], None) == "0"


def full_scan(m, categories, same, same_category):
    kept, target = [], {}
    for o in range(len(m)):
        best, at = -1.0, None
        for a in kept:
            if m[a, o] > best:
                best, at = m[a, o], a
        ok = at is not None and (best >= same or (best >= same_category and categories[at] == categories[o]))
        target[o] = at if ok else o
        kept += [] if ok else [o]
    return target


def test_replay_equals_a_full_scan():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = rng.integers(1, 9)
        m = rng.random((n, n)).round(2)
        categories = rng.integers(0, 2, n).astype(str)
        edges = [(a, b, m[a, b]) for a, b in itertools.combinations(range(n), 2) if m[a, b] >= 0.6]
        nodes = pd.DataFrame({"id": [str(i) for i in range(n)], "ord": range(n), "category": categories, "stored": None, "stored_score": np.nan, "stored_category": None})
        got = duplicates.replay(nodes, pd.DataFrame(edges, columns=["a_ord", "b_ord", "score"]), 0.8, 0.6)
        assert {int(k): int(v) for k, v in zip(got["id"], got["kept"], strict=True)} == full_scan(m, categories, 0.8, 0.6)


def test_sequence_on_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    x = centres[rng.integers(0, 5, 80)] + 0.35 * rng.normal(size=(80, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    categories = rng.integers(0, 2, 80).astype(str)
    df = spark.createDataFrame([(str(i), i, categories[i], x[i].tolist()) for i in range(80)] + [("null", 80, "0", None)], "id string, ord long, category string, embedding array<double>")
    got = {r.id: r.kept for r in duplicates.dedupe_sequence(df).collect()}
    want = full_scan(u @ u.T, categories, duplicates.SAME, duplicates.SAME_CATEGORY)
    assert got == {str(k): str(v) for k, v in want.items()} | {"null": "null"}


def test_rounds_of_joins_equal_the_replay(spark):
    """Groups too large for one task: the same decisions, one round for each step of the longest chain."""
    rng = np.random.default_rng(5)
    for seed, stored in ((6, 0), (7, 15)):
        x = np.random.default_rng(seed).normal(size=(60, 3))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        categories = rng.integers(0, 2, 60).astype(str)
        df = spark.createDataFrame([(str(i), i, categories[i], x[i].tolist()) for i in range(60)], "id string, ord long, category string, embedding array<double>")
        old, new = (df.where(f"ord < {stored}") if stored else None), df.where(f"ord >= {stored}")
        want = full_scan_stored(u @ u.T, categories, 0.9, 0.8, stored)
        for most in (200_000, 0):
            got = {r.id: r.kept for r in duplicates.dedupe_sequence(new, 0.9, 0.8, stored=old, most=most).collect()}
            assert got == {str(k): str(v) for k, v in want.items()}, most


def test_copies_among_arrivals(spark):
    """Rows of one vector: of both categories, around other vectors, stored or not; in tasks and by joins."""
    rng = np.random.default_rng(8)
    schema = "id string, ord long, category string, embedding array<double>"
    for stored in (0, 12):
        few = rng.normal(size=(9, 3))
        x = few[rng.integers(0, 9, 90)]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        m = u @ u.T
        m[(x[:, None] == x[None]).all(2)] = 1.0
        categories = rng.integers(0, 3, 90).astype(str)
        df = spark.createDataFrame([(str(i), i, categories[i], x[i].tolist()) for i in range(90)] + [("zero", 90, "0", [0.0] * 3), ("zero too", 91, "0", [0.0] * 3), ("nan", 92, "0", [float("nan")] * 3)], schema)
        old, new = (df.where(f"ord < {stored}") if stored else None), df.where(f"ord >= {stored}")
        want = full_scan_stored(m, categories, 0.95, 0.6, stored)
        for most in (200_000, 0):
            got = {r.id: r.kept for r in duplicates.dedupe_sequence(new, 0.95, 0.6, stored=old, most=most).collect()}
            assert got == {str(k): str(v) for k, v in want.items()} | {k: k for k in ("zero", "zero too", "nan")}, (stored, most)


def edges_made(monkeypatch):
    """Of each table of edges that is made how many there are."""
    made, similar = [], duplicates.similar_heads

    def count(*args, **kwargs):
        made.append((out := similar(*args, **kwargs)).count())
        return out

    monkeypatch.setattr(duplicates, "similar_heads", count)
    return made


def test_edges_are_made_within_candidates_alone(spark, monkeypatch):
    """Arrivals in waves: the decisions are those of a full scan, but of all pairs that are alike few are made."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(400, 4)).astype(np.float32)
    x[rng.integers(0, 400, 70)] = x[5]
    x[rng.integers(0, 400, 40)] = x[rng.integers(0, 400, 40)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    m = u @ u.T
    m[(x[:, None] == x[None]).all(2)] = 1.0
    categories = rng.integers(0, 3, 400).astype(str)
    rows = [(str(i), i, categories[i] if i % 50 else None, x[i].tolist()) for i in range(400)] + [("zero", 40000, "0", [0.0] * 4), ("none", -1, "0", None), ("inf", -2, "0", [float("inf")] * 4)]
    named = np.array([c if i % 50 else f"no {i}" for i, c in enumerate(categories)])
    pairs = len({(x[a].tobytes(), x[b].tobytes()) for a, b in itertools.combinations(range(400), 2) if m[a, b] >= 0.7 and (x[a] != x[b]).any()})
    made = edges_made(monkeypatch)
    monkeypatch.setattr(duplicates, "UNIT", 60, raising=False)
    for kind, sent, stored in (("float", 4_000_000, 0), ("double", 100, 30)):
        monkeypatch.setattr(duplicates, "SENT", sent, raising=False)
        made.clear()
        df = spark.createDataFrame(rows, f"id string, ord long, category string, embedding array<{kind}>")
        old, new = (df.where("ord between 0 and 29") if stored else None), (df.where("ord not between 0 and 29") if stored else df)
        got = {r.id: r.kept for r in duplicates.dedupe_sequence(new, 0.9, 0.7, stored=old, most=2000).collect()}
        want = full_scan_stored(m, named, 0.9, 0.7, stored)
        assert got == {str(k): str(v) for k, v in want.items()} | {k: k for k in ("zero", "none", "inf")}, (kind, sent, stored)
        assert len(made) > 1 and sum(made) < pairs / 4, (pairs, made)


def test_groups_are_replayed_in_a_task_each(spark):
    """More edges than a task takes, in groups that a task takes: the groups are replayed apart."""
    rng = np.random.default_rng(24)
    x = np.repeat(np.eye(4), 10, 0) + 0.25 * rng.normal(size=(40, 4))
    x[3::10] = x[2::10]
    x = x[rng.permutation(40)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = u @ u.T
    m[(x[:, None] == x[None]).all(2)] = 1.0
    categories = rng.integers(0, 2, 40).astype(str)
    df = spark.createDataFrame([(str(i), i, categories[i], x[i].tolist()) for i in range(40)], "id string, ord long, category string, embedding array<double>")
    got = {r.id: r.kept for r in duplicates.dedupe_sequence(df, 0.95, 0.85, most=60).collect()}
    assert got == {str(k): str(v) for k, v in full_scan_stored(m, categories, 0.95, 0.85, 0).items()}


def test_a_wave_of_far_more_edges_is_cut(spark, monkeypatch):
    """Nothing alike at first, then much: the wave has grown and is cut before its edges are made."""
    rng = np.random.default_rng(22)
    x = np.concatenate([np.eye(80)[:20], np.eye(80)[79:] + 0.35 * rng.normal(size=(80, 80)) / 80**0.5])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(str(i), i, str(i), x[i].tolist()) for i in range(100)], "id string, ord long, category string, embedding array<double>")
    made = edges_made(monkeypatch)
    monkeypatch.setattr(duplicates, "UNIT", 20, raising=False)
    found = {r.id: r.kept for r in duplicates.dedupe_sequence(df, 0.99, 0.5, most=400).collect()}
    want = full_scan_stored(u @ u.T, np.arange(100).astype(str), 0.99, 0.5, 0)
    assert found == {str(k): str(v) for k, v in want.items()}
    assert len(made) > 3 and max(made) <= 400, made


def test_nearest_equals_a_full_scan(spark, monkeypatch):
    """By what is sent and by blocks; ties go to the first, also of lower ords alone; numbers that aren't finite match nothing."""
    rng = np.random.default_rng(23)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(40, 3))
    y[20:30], y[7], x[9] = y[3], np.nan, np.inf
    schema = "id string, ord long, category string, embedding array<double>"
    left = spark.createDataFrame([(f"x{i}", i, "a", x[i].tolist()) for i in range(60)], schema)
    right = spark.createDataFrame([(f"y{i}", i, str(i % 2), y[i].tolist()) for i in range(40)][::-1], schema)
    with np.errstate(invalid="ignore"):
        m = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    m[:, 20:30] = m[:, 3:4]
    for before in (False, True):
        want = {}
        for i in range(60):
            best = max(((m[i, j], -j) for j in range(i if before else 40) if j < 40 and m[i, j] >= 0.7), default=None)
            want[f"x{i}"] = (None, None) if best is None else (f"y{-best[1]}", str(-best[1] % 2))
        for sent in (4_000_000, 0):
            monkeypatch.setattr(duplicates, "SENT", sent)
            got = {r.id: (r.near, r.near_category) for r in duplicates.nearest(left, right, 0.7, block=16, before=before).collect()}
            assert got == want, (before, sent)


def test_cells_lose_no_pair(spark):
    """Clustered vectors: most pairs are left out by the radii, none that is similar; copies meet once as a vector."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 600)] + 0.1 * rng.normal(size=(600, 16))
    x[500:] = x[0]  # 101 copies
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    schema = "id string, ord long, category string, embedding array<double>"
    df = spark.createDataFrame([(str(i), i, "c", x[i].tolist()) for i in range(600)] + [("zero", 600, "c", [0.0] * 16), ("null", 601, "c", None)], schema)
    got = {(int(r.a), int(r.b)): r.score for r in duplicates.similar_pairs(df, df, 0.8, block=16, ordered=True).collect()}
    m = u @ u.T
    want = {(a, b) for a, b in itertools.combinations(range(600), 2) if m[a, b] >= 0.8}
    assert set(got) == want and all(abs(got[p] - m[p]) < 1e-9 for p in want)
    of = duplicates.heads(df.where("embedding is not null")).cache()
    assert of.count() == 501
    plan = duplicates.cells(of, of, 0.8, 16)[2]
    assert sum(v * h for _, v, h in plan) < 0.5 * 501 * 501
    left, right = df.where("ord % 2 = 0"), df.where("ord % 2 = 1")
    two = {(int(r.a), int(r.b)) for r in duplicates.similar_pairs(left, right, 0.8, block=16).collect()}
    assert two == {(a, b) for a in range(0, 600, 2) for b in range(1, 600, 2) if m[a, b] >= 0.8}
    assert {(r.a, r.b) for r in duplicates.similar_pairs(df.where("ord in (1, 600)"), df.where("ord = 600"), 0.0).collect()} == {("1", "zero"), ("zero", "zero")}


def test_pairs_of_vectors_are_not_shuffled(spark, monkeypatch):
    """Copies in several pieces, blocks that meet once or cell by cell, floats and doubles: all pairs once, made where vectors meet."""
    monkeypatch.setattr(duplicates, "PIECE", 8, raising=False)
    monkeypatch.setattr(duplicates, "MADE", 10, raising=False)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(90, 4)).astype(np.float32).astype(float)
    x[60:] = x[3]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = u @ u.T
    for kind in ("float", "double"):
        df = spark.createDataFrame([(str(i), 7 * i % 90, str(i % 2), x[i].tolist()) for i in range(90)] + [("none", 90, "c", []), ("nan", 91, "c", [float("nan")] * 4)], f"id string, ord long, category string, embedding array<{kind}>")
        for least, block in ((0.3, 16), (0.98, 8), (-0.5, 1000)):
            found = duplicates.similar_pairs(df, df, least, block=block, ordered=True)
            rows = found.collect()
            want = {(str(a), str(b)): m[a, b] for a in range(90) for b in range(90) if 7 * a % 90 < 7 * b % 90 and m[a, b] >= least}
            got = {(r.a, r.b): r for r in rows}
            assert len(rows) == len(want) and set(got) == set(want), (kind, least)
            assert all(abs(r.score - want[k]) < 1e-9 and r.a_category == str(int(r.a) % 2) and r.b_ord == 7 * int(r.b) % 90 for k, r in got.items())
            above = found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
            assert "Join" not in above


def full_scan_stored(m, categories, same, same_category, stored):
    """Rows before ``stored`` are kept without a look at each other."""
    kept, target = list(range(stored)), {}
    for o in range(stored, len(m)):
        at = max(kept, key=lambda a: (m[a, o], -a), default=None)
        ok = at is not None and (m[at, o] >= same or (m[at, o] >= same_category and categories[at] == categories[o]))
        target[o] = at if ok else o
        kept += [] if ok else [o]
    return target


def test_arrivals_meet_every_stored_row(spark):
    """A stored row counts also where an earlier stored row resembles it."""
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    schema = "id string, ord long, category string, embedding array<double>"
    stored = spark.createDataFrame([("A", 0, "x", at(0)), ("B", 1, "x", at(25.8))], schema)
    arrival = spark.createDataFrame([("C", 0, "y", at(43.9)), ("D", 1, None, at(60)), ("E", 2, "x", at(-30))], schema)
    got = {r.id: r.kept for r in duplicates.dedupe_sequence(arrival, stored=stored).collect()}
    assert got == {"C": "B", "D": "D", "E": "A"}


def news_rows(spark, rows):
    schema = "id string, ord long, day string, category string, title string, content string, url string, sources array<struct<source_key:string,source_name:string,url:string>>, embedding array<double>"
    return spark.createDataFrame(rows, schema)


def test_merge(spark):
    src = lambda *urls: [("k", "n", u) for u in urls]
    e = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [
        ("a", 0, "d", "c", "bir iki üç dört", "kısa", "ua", src("s1"), e(1.0)), ("b", 1, "d", "c", "bir iki üç dört beş", "uzun içerik", "ub", src("s2", "s1"), e(0.72)),
        ("x", 2, "d", "c", "başka", "x", "ux", src(), e(0.0)), ("y", 3, "e", "c", "bir iki üç dört", "y", "uy", None, e(1.0)), ("n", 4, None, "c", "bir", "z", "un", src("s9"), e(1.0)),
    ]
    news = news_rows(spark, rows)
    pairs = duplicates.merge_pairs(news)
    assert [tuple(r) for r in pairs.collect()] == [(0, 1)]
    out = {r.id: r for r in duplicates.merge_apply(news, duplicates.merge_clusters(news, pairs)).collect()}
    assert sorted(out) == ["b", "n", "x", "y"]
    assert out["b"].content == "uzun içerik" and out["b"].title == "bir iki üç dört beş" and [s.url for s in out["b"].sources] == ["s1", "s2", "ua", "ub"]
    assert out["n"].sources[0].url == "s9"


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# --- geocoding, listing, summaries ---


def test_chain_and_fallback(spark):
    rows = spark.createDataFrame([(1, [" a ", "a", "", None, "b", "c", "d", "e"]), (2, ["e", "b"]), (3, []), (4, None), (5, ["x", "y", "z", "w", "b"])], "id int, candidates array<string>")
    cache = spark.createDataFrame([("e", 5.0, 6.0, "E"), ("d", 1.0, 2.0, "D"), ("b", 0.0, 0.0, "B")], "address string, lat double, lng double, formatted string")
    got = {r.id: r for r in geocode.center_fallback(geocode.geocode_chain(rows, cache), (40.7654, 29.9408), "Kocaeli").collect()}
    assert [got[i].address for i in (1, 2, 3, 4, 5)] == ["b", "e", None, None, None]
    assert not got[1].geocode_fallback and got[5].geocode_fallback and (got[3].lat, got[3].lng) == (40.7654, 29.9408)
    found = geocode.resolve_missing(rows.select(F.explode("candidates").alias("address")), cache, lambda df: df.select("address", F.when(F.col("address") == "x", 1.0).alias("lat"), F.lit(2.0).alias("lng"), F.upper("address").alias("formatted")), dt.datetime(2025, 1, 1))
    assert [(r.address, r.formatted) for r in found.collect()] == [("x", "X")]


def test_listing(spark):
    assert [listing.limit_policy(n) for n in (5000, None, 7)] == [1000, 500, 7]
    assert [listing.fetch_cap(n, True) for n in (10, 100, 1000)] == [500, 2500, 8000] and listing.fetch_cap(10, False) == 10
    now = dt.datetime(2025, 3, 10)
    assert listing.date_bounds(None, "2025-03-04", now) == (dt.datetime(2025, 3, 7), dt.datetime(2025, 3, 5))
    assert listing.date_bounds("abc", None, now) == (None, None)
    day = dt.datetime(2025, 3, 5)
    rows = [("a", "x", day, (1.0,)), ("b", "x", day + dt.timedelta(seconds=1), (None,)), ("c", "y", None, (0.0,))]
    news = spark.createDataFrame([(*r, [1.0]) for r in rows], "_id string, category string, published_at timestamp, location struct<lat:double>, embedding array<double>")
    ids = lambda **k: [r._id for r in listing.query_news(news, **k).collect()]
    assert ids() == ["b", "a", "c"] and ids(date_to=day) == ["a"] and ids(has_location=True) == ["a", "c"] and ids(category="y") == ["c"]
    assert "embedding" not in listing.query_news(news).columns and listing.get_news(news, "a").count() == 1


def test_stats_and_links(spark):
    schema = "category string, location struct<lat:double>, url string, sources array<struct<source_key:string,source_name:string,url:string>>"
    rows = [(None, (0.0,), "u", []), ("", None, "u", [("k", None, "1")]), ("a", (None,), "u0", [("k", "n", "u1"), ("k", "n", "u2"), ("k", "m", "u1"), ("k", "m", "u3"), ("k", "z", "")])]
    news = spark.createDataFrame(rows, schema)
    got = {(r.kind, r.key): r.n for r in listing.stats(news).collect()}
    assert got == {("total", ""): 3, ("mapped", ""): 1, ("by_category", "Diger"): 2, ("by_category", "a"): 1, ("by_source", "Bilinmeyen"): 1, ("by_source", "n"): 1}
    assert [[x.url for x in r.links] for r in listing.source_links(news).collect()][2] == ["u1", "u3"]


def test_summaries(spark):
    long = "Bu cümle yeterince uzun bir cümledir ve haber verir. "
    rows = [("t", "A A"), ("t", "x" * 24), ("t", None), ("t", "Kısa ama yeterli uzunlukta bir metin, "), ("yangın evi", long + "İkinci cümlede hiçbir şey anlatılmıyor gibi. " + long.replace("haber", "yangın") * 9), ("t", "Bu metin bir harfle bitiyor gibi A."), ("t", "BU BAŞLIK BÜYÜK HARFLERLE YAZILDI. " + long)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, content string")
    got = [r.s for r in df.select("i", summaries.summary(F.col("title"), F.col("content")).alias("s")).orderBy("i").collect()]
    assert got[:3] == ["", "", ""] and got[3] == "Kısa ama yeterli uzunlukta bir metin..." and len(got[4]) <= 400 and got[4].startswith("Bu cümle")
    assert got[5] == "Bu metin bir harfle bitiyor gibi..." and got[6] == long.strip()
    words = spark.createDataFrame([("w " * 500,)], "x string")
    assert len(words.select(summaries.truncate(F.col("x"), 40)).collect()[0][0]) <= 39
    df = spark.createDataFrame([(["metin, "],)], "x array<string>")
    assert df.select(summaries.finalize(F.get("x", F.lit(0)))).collect()[0][0] == "metin..."


def test_summaries_look_once(spark):
    """A text's sentences are scored once, cheap tests before expressions; trims, heads and openings as the plain expressions have them."""
    df = spark.createDataFrame([("t", ["a"], "b")], "title string, listed array<string>, content string")
    plan = df.select(summaries.summary(F.col("title"), F.col("content"), F.col("listed")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Jandarma") == 1
    spaces = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    rng = random.Random(3)
    texts = ["", spaces, f"{spaces}a\u200b {spaces}b{spaces}", "A" + " " * 40 + "a", "fotoğraf" + " " * 30 + ":", "Haberin devamı", "x haberin devamı", "AbC 1234567890 1234567890", "A. 1234567890 1234567890", "aB", "ab", "İlgili habere göre, bir şey oldu ve bitti", "ilgili habere göre bitti", "EDİNİLEN BİLGİLERE GÖRE: ANKARA, 12 MART Bir şey", "KOCAELİ, 12 Bir şey oldu", "KOCAELİ Bir şey"]
    texts += ["".join(rng.choice("ABcdé1 .") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    x = F.col("x")
    trim = lambda c: F.regexp_replace(c, f"^[{spaces}]+|[{spaces}]+$", "")
    letters, upper = F.length(F.regexp_replace(x, r"[^\p{L}]", "")), F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    cut = trim(F.regexp_replace(trim(F.regexp_replace(x, summaries.FILLER, "")), summaries.DATELINE, ""))
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    assert rows.where(~trim(x).eqNullSafe(text_functions.py_trim(x))).count() == 0
    rows = rows.select(trim(x).alias("x"))
    assert rows.where(~x.rlike(summaries.JUNK).eqNullSafe(summaries.is_junk(x))).count() == 0
    assert rows.where(~((letters > 0) & (upper > 0.65 * letters) & (F.length(x) < 120)).eqNullSafe(summaries.is_header(x))).count() == 0
    assert rows.where(~cut.eqNullSafe(summaries.without_openings(x))).count() == 0


# --- pages and store ---

PAGE = """<html><head><meta property="og:description" content="Bir açıklama metni burada duruyor ve uzun."><script type="application/ld+json">{"@graph":[{"datePublished":"2025-03-04T10:00:00+03:00"}]}</script></head>
<body><h1> Başlık <b>metni</b></h1><div class="news-content">kısa</div><div class="xx article-body"><p>Birinci paragraf yeterince uzun bir metin içerir ve sürer.<script>var a='</p>';</script><p>İkinci<button>Paylaş</button></div>
<a href="/haber/1/a#c">1</a><a href="#top">2</a><a href="javascript:void(0)">3</a><a href="http://other/haber/2/b">4</a><a href="/haber/1/a">5</a><a href=" ">6</a></body>"""


def test_page(spark):
    p = pages.parse_page(PAGE)
    assert p["h1"] == "Başlıkmetni" and p["selector"] == "Birinci paragraf yeterince uzun bir metin içerir ve sürer. İkinci" and p["json_dates"] == ["2025-03-04T10:00:00+03:00"]
    rows = [(1, "http://s/x", PAGE), (2, "http://s/2025/03/05/y", "<h1>T</h1>"), (3, "http://s/z", "<p>no heading"), (4, "u", None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r for r in pages.parse_articles(df).collect()}
    assert sorted(got) == [1, 2] and got[1].published_at == dt.datetime(2025, 3, 4, 7) and got[2].published_at == dt.datetime(2025, 3, 5) and got[2].content == "T"
    links = pages.collect_links(df.withColumn("base", F.lit("http://s/")), r"/haber/\d+/[^\s]+", "base")
    assert [(r.url, r.ord) for r in links.collect()] == [("http://s/haber/1/a", 1)]


def test_reading_stops(spark):
    page = lambda *n: "".join(f'<a href="/n/{i}">x</a>' for i in n)
    html = [page(1, 2), page(2), page(1), page(3), None, None, page(4)]
    df = spark.createDataFrame([(i, "http://s", h) for i, h in enumerate(html)], "page_id int, base string, html string")
    urls = lambda **k: [r.url[-1] for r in sorted(pages.collect_links(df, "/n/", "base", **k).collect(), key=lambda r: r.ord)]
    assert urls() == ["1", "2", "3", "4"] and urls(idle=2) == ["1", "2"] and urls(fetches=4) == ["1", "2", "3"] and urls(most=1) == ["1"] and urls(failures=2) == ["1", "2", "3"]


def test_each_site_is_read_up_to_its_own_limits(spark, tmp_path):
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", f'<a href="/n/{i}">x</a>') for i in range(80)] + [(80, None, "<p>")]
    spark.createDataFrame(rows, "page_id int, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.source, r.url) for r in queries.queries()["collect_links"](spark, str(tmp_path)).collect()}
    assert got == {(f"{x}.example", f"http://{x}.example/n/{i}") for i in range(80) for x in "ab"[i % 2]}


def test_date_elements_in_their_order():
    dates = lambda html: pages.parse_page(html)["class_dates"]
    assert dates('<div class="update-note">1.1.2020</div><span class="haber-tarih">4.3.2025</span>')[0] == "4.3.2025"
    assert dates('<li class="haber-tarih">4.3.2025</li>') == ["4.3.2025"] and dates('<p class="a info">5.3.2025</p>') == ["5.3.2025"]
    assert dates('<p class="date">first</p><p class="date">second</p>') == ["first", "first"]
    assert dates('<p class="Date">x</p>') == [] and dates('<p class="updated-times">x</p>') == ["x", "x"]
    assert pages.parse_page("<time>10:30</time><time datetime=' 2025-03-04 '>4 Mart 2025</time>")["time_dates"] == ["2025-03-04", "4 Mart 2025"]


def test_one_counter_of_failures_and_idle_pages(spark):
    link = '<a href="/n/{}">x</a>'
    none, idle = None, "<p>"

    def read(html):
        df = spark.createDataFrame([(i, "http://s", h) for i, h in enumerate(html)], "page_id int, base string, html string")
        return sorted(r.url[-1] for r in pages.collect_links(df, "/n/", "base").collect())

    first, last = link.format(1), link.format(2)
    assert read([first, *[none] * 11, last]) == ["1", "2"]  # eleven failures don't stop it
    assert read([first, *[none] * 12, last]) == ["1"]
    assert read([first, *[none] * 9, idle, last]) == ["1"]  # the tenth in a row is an idle page
    assert read([first, *[none] * 8, idle, last]) == ["1", "2"]
    assert read([first, *[idle] * 9, none, last]) == ["1", "2"]
    assert read(['<a href=" #top">x</a><a href="x javascript:0">y</a>' + first]) == ["1"]


def test_sources(spark):
    assert [s.key for s in specs.chosen(specs.TURKISH_SOURCES, ["seskocaeli", "yenikocaeli"])] == ["seskocaeli", "yenikocaeli"] and len(specs.chosen(specs.TURKISH_SOURCES)) == 5
    with pytest.raises(ValueError):
        specs.chosen(specs.TURKISH_SOURCES, ["nope"])
    urls = [r.url for r in specs.listing_urls(spark, specs.chosen(specs.TURKISH_SOURCES, ["yenikocaeli"])).orderBy("ord").collect()]
    assert urls[:4] == ["https://www.yenikocaeli.com", "https://www.yenikocaeli.com/haber/guncel", "https://www.yenikocaeli.com/haber/kocaeli", "https://www.yenikocaeli.com/haber/yasam.html"] and len(urls) == 14
    fetched = spark.createDataFrame([("seskocaeli", 0, '<a href="/haber/12/x">a</a><a href="/ab-c-77.html">b</a><a href="/other">c</a>'), ("yenikocaeli", 0, '<a href="/haber/12/x">a</a><a href="/haber/g/x/9.html">b</a>')], "source_key string, ord int, html string")
    got = sorted((r.source, r.url) for r in specs.collect_articles(fetched, specs.TURKISH_SOURCES).collect())
    assert got == [("seskocaeli", "https://www.seskocaeli.com/ab-c-77.html"), ("seskocaeli", "https://www.seskocaeli.com/haber/12/x"), ("yenikocaeli", "https://www.yenikocaeli.com/haber/g/x/9.html")]
    assert specs.of_sources(fetched, ["seskocaeli"]).count() == 1 and specs.of_sources(fetched, None).count() == 2


def test_json_and_dimensions(spark, tmp_path):
    news = spark.createDataFrame([("1", None, dt.datetime(2025, 3, 4, 5), [1.0])], "_id string, title string, published_at timestamp, embedding array<double>")
    listing.to_json(news, f"file://{tmp_path}/out")
    (line,) = [x for f in tmp_path.glob("out/*.json") for x in f.read_text().splitlines()]
    assert json.loads(line) == {"_id": "1", "title": None, "published_at": "2025-03-04T05:00:00"}
    assert [tuple(r) for r in dimensions.categories(spark, TURKISH).orderBy("ord").collect()][3] == (3, "Suc ve Cinayet", "Suç ve Cinayet")
    assert dimensions.districts(spark, TURKISH).count() == 12


def test_pagination(spark):
    df = spark.createDataFrame([(0, "http://s/x/"), (1, "http://s/x?a=1"), (2, "http://s/x")], "ord int, url string")
    got = [r.url for r in sorted(pages.expand_pagination(df).collect(), key=lambda r: (r.ord, r.pos))]
    assert got == [f"http://s/x{e}" for e in ("", "?page=2", "?sayfa=2", "?page=3", "?sayfa=3")] + [f"http://s/x?a=1{e}" for e in ("", "&page=2", "&sayfa=2", "&page=3", "&sayfa=3")]


def test_store(spark, tmp_path):
    schema = snapshots.CACHE
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/cache", schema)
    assert store.read().count() == 0
    row = lambda a, lat: (a, lat, 0.0, a, dt.datetime(2025, 1, 1))
    new = lambda *rows: spark.createDataFrame(list(rows), schema)
    for rows in ([row("a", 1.0), row("b", 2.0)], [row("b", 3.0)], [row("b", 3.0)], [row(None, 9.0), row("", 9.0)]):
        store.write(snapshots.upsert(store.read(), new(*rows), "address", None))
    assert sorted((r.address, r.lat) for r in store.read().collect()) == [("a", 1.0), ("b", 3.0)]
    assert len(store.versions()) == 2
    with pytest.raises(ValueError):
        store.clear()
    assert store.clear(confirm=True) == 2 and store.read().count() == 0


# --- the Turkish profile ---


def by_hand(text, keyword):
    """Occurrences of a keyword in a lower-cased text by one expression."""
    letters, k = "a-zçğıöşü", keyword.strip()
    if k == "kesinti":
        return len(re.findall(rf"(?<![{letters}])kesinti(?!siz)[{letters}]{{0,8}}(?![{letters}])", text))
    suffix = "" if " " in k else f"[{letters}]{{0,8}}"
    return len(re.findall(rf"(?<![{letters}]){re.escape(k)}{suffix}(?![{letters}])", text))


def test_keywords_with_digits_hyphens_and_apostrophes(spark):
    keywords = ["d100", "d-100", "tem'de", "kaza", "kesinti", "trafik kazası", "112 acil", "7/24", " e-5 "]
    texts = ["d100'de kaza, d-100 yolunda kazalar; d1000 ve ad100 değil", "tem'de tem'deki xtem'de 112 acil 112 acilde", "kesintisiz kesinti kesintiler 7/24 7/24'te e-5 e-5te ee-5", "", None, "trafik kazası d100d100 d-100karayolundakiler"]
    lexicon = spark.createDataFrame([("c", k, 1) for k in keywords] + [("c", " ", 1)], "category string, keyword string, weight int")
    docs = spark.createDataFrame([(i, "d100 kaza", t) for i, t in enumerate(texts)], "doc_id int, title string, body string")
    got = {(r.id, r.keyword): (r.n_title, r.n_body) for r in scoring.keyword_hits(docs, lexicon, TURKISH).collect()}
    want = {(i, k): (by_hand("d100 kaza", k), by_hand(t or "", k)) for i, t in enumerate(texts) for k in keywords}
    assert got == {k: v for k, v in want.items() if v != (0, 0)}


def test_turkish_rules(spark):
    """Combination, address and reset rules, each alone."""
    rows = [
        ("Otoyolda zincirleme kaza", "araçlar çarpıştı", "", {"Trafik Kazasi": 14}), ("Fabrikada yangın çıktı", "", "", {"Yangin": 11}),
        ("Elektrik kesintisi duyurusu", "", "", {"Elektrik Kesintisi": 14}), ("Kesintisiz elektrik kesintisi", "", "", {}), ("Su kesintisi", "elektrik kesintisi", "", {}),
        ("Soygun", "", "", {"Hirsizlik": 9}), ("Soygun ve cinayet", "", "", {"Suc ve Cinayet": 14}), ("Konser", "etkinlik düzenlendi", "", {"Kulturel Etkinlikler": 9}),
        ("x", "y", "https://s/trafik", {"Trafik Kazasi": 12}), ("x", "y", "https://s/kaza-haberi", {"Trafik Kazasi": 12}), ("x", "y", "https://s/kazan", {}),
        ("x", "y", "https://s/sedas-duyurdu", {"Elektrik Kesintisi": 14}), ("x", "y", "https://s/kesinti-var", {"Elektrik Kesintisi": 8}), ("x", "y", "https://s/kesintisiz-kesinti", {}),
        ("elektrik üretimi", "y", "https://s/sedas", {}), ("x", "y", "https://s/kultur-sanat", {"Kulturel Etkinlikler": 17}), ("x", "y", "https://s/asayis", {"Trafik Kazasi": 7, "Suc ve Cinayet": 8, "Hirsizlik": 5}),
    ]
    docs = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "doc_id int, title string, body string, url string")
    got = {r.id: r.asDict() for r in scoring.rule_deltas(docs, TURKISH.rules, TURKISH.categories, url_col="url").collect()}
    for i, r in enumerate(rows):
        assert {c: got[i][f"delta_{k}"] for k, c in enumerate(TURKISH.categories) if got[i][f"delta_{k}"]} == r[3], r
    power = TURKISH.categories.index("Elektrik Kesintisi")
    assert [i for i in got if got[i][f"reset_{power}"]] == [14]


def test_equal_scores_and_rules_of_a_table(spark):
    lexicon = spark.createDataFrame([("Hirsizlik", "abc", 9), ("Suc ve Cinayet", "abc", 9), ("Yangin", "def", 9)], "category string, keyword string, weight int")
    docs = spark.createDataFrame([(1, "abc", "x"), (2, "def", "abc")], "doc_id int, title string, body string")
    table = spark.createDataFrame([(0, "r", "text", ["def"], ["zzz"], "Yangin", -450, None), (0, "r", "text", ["def"], ["zzz"], "Hirsizlik", 1, None)], "ord int, name string, field string, must array<string>, must_not array<string>, category string, delta int, group string")
    rules = scoring.rules_from(table)
    assert rules == (Rule("r", ("def",), (("Yangin", -450), ("Hirsizlik", 1)), ("zzz",)),)
    got = {r.id: r.category for r in scoring.classify(docs, lexicon, dataclasses.replace(TURKISH, rules=rules)).collect()}
    assert got == {1: "Suc ve Cinayet", 2: "Hirsizlik"}


def test_addresses_to_try(spark):
    df = spark.createDataFrame([("L, Kocaeli, Türkiye", "L, Kocaeli", "Gebze"), (None, None, None), ("q", "q", None)], "q string, t string, d string")
    got = [r.c for r in df.select(location.geocode_candidates(F.col("q"), F.col("t"), F.col("d"), TURKISH).alias("c")).collect()]
    last = ["İzmit, Kocaeli, Türkiye", "Izmit, Kocaeli, Turkey", "Kocaeli, Türkiye"]
    assert got == [["L, Kocaeli, Türkiye", "L, Kocaeli", "Gebze, Kocaeli, Türkiye", *last], last, ["q", *last]]


def test_names_within_texts(spark, monkeypatch):
    """Against a plain search: names within each other, repeated rows, one name in two districts, no text, no name."""
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("abç"), n))
    rows = [(letters(rng.integers(1, 5)), str(rng.choice(["x", "y"]))) for _ in range(60)]
    rows += [("ABC", "x"), ("abc", "x"), ("", "x"), (None, "y"), ("a", None)]
    texts = [(i, letters(rng.integers(0, 30))) for i in range(40)] + [(40, None), (41, "")]
    gazetteer = spark.createDataFrame(rows, "name string, district string")
    docs = spark.createDataFrame(texts, "id int, t string")
    named = [(n.lower(), d) for n, d in rows if n and d]
    want = {i: sorted((n, d) for n, d in named if n in (s or "")) for i, s in texts}
    for most in (200_000, 9):
        monkeypatch.setattr(location, "BROADCAST_NAMES", most)
        got = location.with_names(docs, gazetteer, {"found": F.col("t")}).collect()
        assert {r.id: [(x.name, x.district) for x in r.found] for r in got} == want, most
    none = location.with_names(docs, gazetteer.limit(0), {"found": F.col("t")}).collect()
    assert all(r.found == [] for r in none) and len(none) == len(texts)


def test_similar_titles(spark):
    """Sets of all sizes, many alike, against all pairs of a bucket; none without tokens or bucket."""
    rng = np.random.default_rng(12)
    words = np.array([f"w{i}" for i in range(14)])
    rows = [(i, "ab"[i % 2], [str(w) for w in rng.choice(words, rng.integers(1, 8))]) for i in range(150)]
    rows += [(200, None, ["w1"]), (201, None, ["w1"]), (202, "a", []), (203, "a", None)]
    df = spark.createDataFrame(rows, "id int, bucket string, tokens array<string>")
    for least in (0.3, 0.5, 2 / 3, 1.0):
        got = [(r.a, r.b, round(r.jaccard, 9)) for r in duplicates.similar_titles(df, least).collect()]
        want = {}
        for (i, b, x), (j, c, y) in itertools.combinations([r for r in rows if r[1] and r[2]], 2):
            score = len(set(x) & set(y)) / len(set(x) | set(y))
            if b == c and score >= least:
                want[i, j] = round(score, 9)
        assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want, least


def test_copies_of_titles_are_dealt(spark, monkeypatch):
    """Many rows of few sets, in several pieces: each pair once, their making shared by tasks, cheap conditions first."""
    monkeypatch.setattr(duplicates, "PIECE", 16, raising=False)
    monkeypatch.setattr(duplicates, "DEAL", 64, raising=False)
    sets = (["w1", "w2"], ["w2", "w1", "w2"], ["w2", "w3", "w1"], ["w4"])
    rows = [(i, "a", sets[0 if i < 400 else i % 4]) for i in range(500)] + [(600, "b", ["w1", "w2"])]
    found = duplicates.similar_titles(spark.createDataFrame(rows, "id int, bucket string, tokens array<string>"), 0.6)
    got = [(r.a, r.b, round(r.jaccard, 9), r.task) for r in found.withColumn("task", F.spark_partition_id()).collect()]
    want = {}
    for (i, b, x), (j, c, y) in itertools.combinations(rows, 2):
        score = len(set(x) & set(y)) / len(set(x) | set(y))
        if b == c and score >= 0.6:
            want[i, j] = round(score, 9)
    assert len(got) == len(want) and {(a, b): s for a, b, s, _ in got} == want
    tasks = [t for *_, t in got]
    assert max(tasks.count(t) for t in set(tasks)) < 0.6 * len(got)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "array_intersect" in x and "Join" in x]
    assert joins and all(x.index("greatest") < x.index("array_intersect") for x in joins)


def test_stats_by(spark):
    source = "array<struct<source_name:string>>"
    news = spark.createDataFrame([("a", [("s",)], dt.datetime(2024, 1, 1)), ("", [(None,)], None), (None, [], dt.datetime(2024, 1, 1, 5)), ("a", None, None)], f"category string, sources {source}, published_at timestamp")
    got = {(r.level, r.category, r.source, str(r.day) if r.day else None): r.n for r in listing.stats_by(news).collect()}
    assert got == {
        (7, None, None, None): 4, (3, "a", None, None): 2, (3, "Diger", None, None): 2, (5, None, "s", None): 1, (5, None, "Bilinmeyen", None): 1, (5, None, None, None): 2,
        (1, "a", "s", None): 1, (1, "Diger", "Bilinmeyen", None): 1, (1, "Diger", None, None): 1, (1, "a", None, None): 1, (6, None, None, "2024-01-01"): 2, (6, None, None, None): 2,
    }


def test_a_long_gazetteer(spark, monkeypatch):
    names = [(f"yer{i:03}x", "Gebze" if i % 2 else "Izmit") for i in range(40)]
    gazetteer = spark.createDataFrame(names, "name string, district string")
    docs = spark.createDataFrame([(1, "yer003x", "yer004x yer005x"), (2, "yok", "yer039x Yer006x Mahallesi")], "doc_id int, title string, body string")
    read = lambda: {(r.id, r.district): r.score for r in location.district_scores(docs, TURKISH, gazetteer).collect()}
    whole = read()
    assert whole == {(1, "Gebze"): 110, (1, "Izmit"): 30, (2, "Gebze"): 30, (2, "Izmit"): 30}
    monkeypatch.setattr(location, "BROADCAST_NAMES", 7)
    assert read() == whole and location.extract_location(docs, TURKISH, gazetteer).where("address is not null").first().address.endswith("Yer006x Mahallesi")


def test_short_articles_and_open_references(spark):
    html = "<article><h1>a &amp;&amp b</h1><p>c&lt;d &copy e &ampx; &#39;</p><script>'&amp'</script></article>"
    df = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    short = pages.parse_articles(df, least=0, closed=True).first()
    assert (short.title, short.content) == ("a &&amp b", "a &&amp b c<d &copy e &ampx; '")
    assert pages.parse_articles(df).first().content == "a && b"


def test_sentences_begin_with_one_capital(spark):
    letters = ["ß", "ŉ", "ﬁ", "ᾳ", "é", "ǆ", "x", "1"]
    df = spark.createDataFrame([(i, f"{c}abc def ghi jkl mno pqr stu.") for i, c in enumerate(letters)], "i int, t string")
    got = [r.s[0][0] for r in df.orderBy("i").select(summaries.sentences(F.col("t")).alias("s")).collect()]
    assert got == ["ẞ", "ŉ", "ﬁ", "ᾼ", "É", "Ǆ", "X", "1"]


@pytest.mark.parametrize("block", [7, 1000])
def test_merge_pairs_over_blocks(spark, monkeypatch, block):
    """Against all pairs one by one: zero and odd vectors, no category, titles between the bounds, a cosine at a bound."""
    monkeypatch.setattr(duplicates, "BLOCK", block)
    monkeypatch.setattr(duplicates, "CHUNK", 3)
    rng = random.Random(4)
    rows = []
    for i in range(60):
        v = [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] if i % 11 else [0.0] * 3
        rows.append((str(i), i, rng.choice("de"), rng.choice(["x", "y", None]), " ".join(rng.choice(["bir", "iki", "üçü", "dört", "ab"]) for _ in range(3)), "t", f"u{i}", None, v))
    rows += [("100", 100, "d", "x", "bir", "t", "u", None, [1.0, float("nan"), 0.0]), ("101", 101, "d", "x", None, "t", "u", None, None), ("102", 102, "d", "x", "bir", "t", "u", None, [1.0, 0.0])]
    words = lambda t: {w for w in t.split() if len(w) > 2}

    def alike(p, q):
        length = sum(x * x for x in p[8]) ** 0.5 * sum(x * x for x in q[8]) ** 0.5
        s = sum(x * y for x, y in zip(p[8], q[8], strict=True)) / length if length else 0.0
        t, u = words(p[4]), words(q[4])
        return s >= 0.8 or (s >= 0.5 and bool(t and u) and len(t & u) / len(t | u) >= 0.5)

    want = {(p[1], q[1]) for p, q in itertools.combinations(rows[:60], 2) if p[2:4] == q[2:4] and alike(p, q)}
    got = [tuple(r) for r in duplicates.merge_pairs(news_rows(spark, rows), 0.8, 0.5, 0.5).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_merged_sources_of_a_large_cluster(spark):
    """A row without sources takes part; the time doesn't grow with the square of the addresses."""
    src = lambda *urls: [("k", None, u) for u in urls]
    rows = [(str(i), i, "d", "c", "t", "x" * (i == 7), f" u{i} ", src(f"s{i % 3}", "", f"u{i - 1}") if i % 2 else None, [1.0]) for i in range(3000)]
    news = news_rows(spark, rows)
    clusters = news.selectExpr("id", "ord", "0L as cluster")
    (got,) = duplicates.merge_apply(news, clusters).collect()
    want = list(dict.fromkeys([u for i in range(1, 3000, 2) for u in (f"s{i % 3}", f"u{i - 1}")] + [f"u{i}" for i in range(3000)]))
    assert [s.url for s in got.sources] == want and got.id == "7"
    assert {(s.url, s.source_name) for s in got.sources if s.url in ("u1", "s1")} == {("u1", "Haber"), ("s1", "Kaynak")}


def test_replay_with_rows_known_to_be_kept():
    """A forced row is a target from its place on and is not returned."""
    row = lambda i, forced: (i, i_, "c", None, None, None, i_, forced) if (i_ := int(i)) is not None else None
    nodes = pd.DataFrame([row("3", False), row("1", False), row("2", True)], columns=["id", "ord", "category", "stored", "stored_score", "stored_category", "vector", "forced"])
    edges = pd.DataFrame([(2, 3, 0.9), (1, 2, 0.95)], columns=["a_ord", "b_ord", "score"])
    got = duplicates.replay(nodes, edges, 0.88, 0.8)
    assert dict(zip(got["id"], got["kept"], strict=True)) == {"1": "1", "3": "2"}


def test_words_looked_up_equal_the_joins(spark, monkeypatch):
    """Both ways to find keywords agree, and a short lexicon sends no words, only what is found."""
    rng = random.Random(9)
    pieces = ["kaza", "kazası", "kesinti", "kesintisiz", "yangın çıktı", "ab", "abc", " ", "  ", ",", "\n", "|", "a", "9"]
    rows = [("".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(4)), "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(25)), "") for _ in range(120)] + [(None, "KAZA", "")]
    lexicon = [("T", "kaza", 5), ("E", "kesinti", 3), ("Y", "yangın çıktı", 4), ("Y", "a", 1), ("T", "ab", 1), ("T", "AB", 2), ("E", "a ab abc", 2), ("E", "ab ab", 2)]
    looked = scored(spark, rows, lexicon)[2]
    assert "ArrowEvalPython" in looked._jdf.queryExecution().toString()
    got = sorted(map(tuple, looked.collect()))
    monkeypatch.setattr(scoring, "BROADCAST_KEYWORDS", 0)
    assert got == sorted(map(tuple, scored(spark, rows, lexicon)[2].collect())) and len(got) > 200


def test_veto_moves_no_texts_and_names_begin_words(spark):
    docs = spark.createDataFrame([(1, "Gebze'de", "xgebzede"), (2, "a", "xgebzede gebzede"), (3, "a", "xgebzede")], "doc_id long, title string, body string")
    world = Profile(categories=("x",), districts=(("Gebze", ("gebze",)),))
    assert {r.id: r.score for r in location.district_scores(docs, world).collect()} == {1: 100 + 2 + 35 + 40, 2: 2 + 35, 3: 1}
    veto = queries.queries()["foreign_city_veto"](spark, "/root/testdata/sf0.001")
    plan = veto._jdf.queryExecution().optimizedPlan()
    while "Join" not in plan.nodeName():
        plan = plan.children().head()
    assert [f.name() for f in [plan.children().head().schema().apply(i) for i in range(plan.children().head().schema().size())]] == ["doc_id", "named"]


def test_finds_of_a_batch_take_little_memory(spark):
    listed = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i % 7)}x" for i in range(500)]
    find = location._finder(spark.sparkContext.broadcast([(n, ["A", "B"] if i == 3 else ["A"]) for i, n in enumerate(listed)]))
    tracemalloc.start()
    found = find.func(pa.array([" ".join(listed), None, *[" ".join(listed)] * 1000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.value_lengths().to_pylist() == [501, 0, *[501] * 1000] and found[0][0].as_py() == {"name": min(listed), "district": "A"}
    assert peak < 20_000_000  # a dictionary for each find takes 200 MB


def test_labels_that_are_components_do_not_move(spark):
    step = spark.createDataFrame([(1, 1), *[(i, 1) for i in range(2, 50)], (60, 59), (59, 58), (58, 58)], "id long, c long")
    assert [tuple(r) for r in graph.moves(step).collect()] == [(59, 58)]
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)] + [(120, 230)], "a long, b long")
    assert {r.component for r in graph.components(edges).collect()} == {100}
