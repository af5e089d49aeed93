import math
import random

import numpy as np
import pytest

from newsloom.llm import langid

SYLLABLES = {"xx": ["ka", "lo", "mi", "ru"], "yy": ["sch", "ung", "heit", "ver"], "zz": ["é", "eau", "que", "tion"]}
SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double"


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, prose(lang, 80, rng), lang, "", 0.0) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(9000, None, "xx", "", 0.0), (9001, "text", None, "", 0.0)]
    return langid.train(spark.createDataFrame(rows, SCHEMA))


def test_predictions_and_odd_rows(spark, model):
    rng = random.Random(2)
    langs = list(SYLLABLES) * 30
    rows = [(i, prose(lang, 20, rng), lang, "keep", 1.0) for i, lang in enumerate(langs)]
    rows += [(100, None, "xx", "", 0.0), (101, "", None, "", 0.0), (102, "12 ²³ !?", "yy", "", 0.0), (None, prose("yy", 30000, rng), "yy", "", 0.0), (0, rows[0][1], "xx", "", 0.0)]
    out = langid.predict(spark.createDataFrame(rows, SCHEMA), model, keep=["doc_id", "lang", "lang_pred"])
    assert out.columns[:3] == ["doc_id", "lang", "lang_pred"] and len(out.columns) == 6
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows)
    right = sum(r[1] == r[3] for r in got if r[0] is not None and r[0] < 100)
    assert right >= 0.97 * 91
    odd = {r[0]: r[3:5] for r in got if r[0] is None or r[0] >= 100}
    assert [odd[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3 and odd[None][0] == "yy"
    assert all(0 <= r[4] <= 1 for r in got)


def test_mixture_proportions(model):
    rng = random.Random(3)
    table = langid.WordTable(model)
    bags = [langid.text_words(prose("xx", 300, rng) + " " + prose("yy", 100, rng)), langid.text_words(prose("zz", 200, rng))]
    pi, active = langid.infer(table, bags)
    at = [model.languages.index(x) for x in ("xx", "yy", "zz")]
    assert abs(pi[0, at[0]] - 0.75) < 0.05 and abs(pi[0, at[1]] - 0.25) < 0.05
    assert active[0, at].tolist() == [1, 1, 0] and active[1, at].tolist() == [0, 0, 1]


def test_em_equals_a_plain_loop(model):
    rng = np.random.default_rng(4)
    like, n = rng.random((7, 3)), rng.integers(1, 5, 7).astype(float)
    got, _ = langid._em(np.log(like), n, np.array([0, 0, 0, 0, 1, 1, 1]), np.array([0, 4]), np.ones((2, 3)), 25)
    for d, rows in ((0, range(4)), (1, range(4, 7))):
        pi = np.full(3, 1 / 3)
        for _ in range(25):
            new = np.zeros(3)
            for r in rows:
                new += n[r] * like[r] * pi / (like[r] @ pi)
            pi = new / sum(n[r] for r in rows)
        assert np.allclose(pi, got[d])


def test_word_table_forgets(model):
    small = langid.WordTable(model, limit=5)
    bags = [langid.text_words("kalo miru lolo kaka"), langid.text_words("ungheit verung schung")]
    assert np.allclose(small.rows(bags[:1]), model.word_scores(list(bags[0])))
    assert np.allclose(small.rows(bags), model.word_scores([w for b in bags for w in b]))


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = langid.train(empty)
    assert langid.predict(empty, model).count() == 0
    row = langid.predict(spark.createDataFrame([(1, "abc", None, "", 0.0)], SCHEMA), model, keep=["doc_id"]).collect()[0]
    assert tuple(row)[1:3] == ("und", 0.0)


def test_long_runs_are_read_whole(model):
    rng = random.Random(6)
    run = "".join(prose("xx", 60, rng).split())[:60] + "".join(prose("yy", 400, rng).split())
    bag = langid.text_words(run + " " + run)
    assert max(map(len, bag)) <= 60
    have = {w[i : i + 4] for w in bag for i in range(len(w) - 3)}
    assert have >= {run[i : i + 4] for i in range(len(run) - 3)} and min(bag.values()) == 2
    pi, _ = langid.infer(langid.WordTable(model), [bag])
    assert pi[0].argmax() == model.languages.index("yy") and pi[0].max() > 0.8
    for n in range(60, 180):
        pieces = langid.text_words("".join(chr(0x4E00 + i) for i in range(n)))
        assert {c for w in pieces for c in w} == {chr(0x4E00 + i) for i in range(n)} and min(map(len, pieces)) > 3


def plain_grams(word):
    """Buckets of all n-grams of a word between its boundaries, in plain integers."""
    text, out = [2, *map(ord, word), 3], []
    for i in range(len(text)):
        h = 0
        for n in range(1, 5):
            if i + n > len(text):
                break
            h = ((h ^ text[i + n - 1]) * 0x100000001B3 + n) % (1 << 64)
            out.append((((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % (1 << 64)) >> 48)
    return out


def plain_words(text):
    """Runs of letters; those over 60 letters in pieces of 60 that overlap by three."""
    runs, run = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            runs += [run] if len(run) <= 60 else [run[i : i + 60] for i in range(0, len(run) - 3, 57)]
            run = ""
    return runs


def plain_predict(train_rows, text):
    """Language, its proportion and the set of languages, one word and one language after another."""
    langs = sorted({lang for _, lang in train_rows})
    counts = {lang: {} for lang in langs}
    for t, lang in train_rows:
        for w in plain_words(t):
            for g in plain_grams(w):
                counts[lang][g] = counts[lang].get(g, 0) + 1
    logs = lambda w, lang: sum(math.log((counts[lang].get(g, 0) + 0.5) / (sum(counts[lang].values()) + 0.5 * 65536)) for g in plain_grams(w)) / 4
    words = plain_words(text)
    table = {w: [logs(w, lang) for lang in langs] for w in set(words)}
    rows = [table[w] for w in words]
    mix = lambda row, pi: max(row) + math.log(sum(p * math.exp(x - max(row)) for p, x in zip(pi, row, strict=True))) if any(p and x > max(row) - 700 for p, x in zip(pi, row, strict=True)) else max(math.log(p) + x for p, x in zip(pi, row, strict=True) if p)
    chosen = [max(range(len(langs)), key=lambda j: sum(r[j] for r in rows))]
    pi = [float(j == chosen[0]) for j in range(len(langs))]
    ll = sum(mix(r, pi) for r in rows)
    while len(chosen) < len(langs):
        log_add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        gain = {j: sum(log_add(math.log(0.8) + mix(r, pi), math.log(0.2) + r[j]) for r in rows) for j in range(len(langs)) if j not in chosen}
        trial = [*chosen, max(gain, key=gain.get)]
        new = [1 / len(trial) if j in trial else 0.0 for j in range(len(langs))]
        for _ in range(12):
            got = [0.0] * len(langs)
            for r in rows:
                top = max(r[j] for j in trial)
                joint = [new[j] * math.exp(r[j] - top) if j in trial else 0.0 for j in range(len(langs))]
                got = [g + x / sum(joint) for g, x in zip(got, joint, strict=True)]
            new = [g / len(rows) for g in got]
        new_ll = sum(mix(r, new) for r in rows)
        if 2 * (new_ll - ll) <= 4.0 * math.log(len(rows) + 1):
            break
        chosen, pi, ll = trial, new, new_ll
    best = max(range(len(langs)), key=lambda j: pi[j])
    return langs[best], pi[best], sorted(langs[j] for j in chosen)


def test_predictions_equal_a_plain_version(spark):
    rng = random.Random(8)
    train_rows = [(prose(lang, 25, rng), lang) for lang in list(SYLLABLES) * 4] + [("".join(chr(0x4E00 + rng.randrange(40)) for _ in range(200)), "cj") for _ in range(3)]
    df = spark.createDataFrame([(i, t, lang, "", 0.0) for i, (t, lang) in enumerate(train_rows)], SCHEMA)
    texts = [prose("xx", 12, rng), prose("xx", 30, rng) + " " + prose("yy", 25, rng), "".join(prose("zz", 40, rng).split()), "".join(chr(0x4E00 + rng.randrange(40)) for _ in range(150)), "q" * 500, "Éa1b²c " + prose("yy", 5, rng)]
    asked = spark.createDataFrame([(i, t, None, "", 0.0) for i, t in enumerate(texts)], SCHEMA)
    got = {r[0]: r for r in langid.predict(asked, langid.train(df)).collect()}
    for i, text in enumerate(texts):
        lang, share, chosen = plain_predict(train_rows, text)
        assert got[i][1] == lang and abs(got[i][2] - share) < 1e-3 and sorted(got[i][3]) == chosen, i


def test_likelihoods_far_apart_stay_apart():
    """Differences of thousands of nats, that an exponential can't hold."""
    scores = np.array([[0.0, -2000.0, -2001.0], [-3000.0, 0.0, -1.0], [0.0, -5.0, -900.0]])
    pi, ll = langid._em(scores, np.ones(3), np.zeros(3, int), np.array([0]), np.array([[0.0, 1.0, 1.0]]), 30)
    assert np.isfinite(ll).all() and abs(pi.sum() - 1) < 1e-9 and ll[0] < -2004
    again, _ = langid._em(scores[:, ::-1], np.ones(3), np.zeros(3, int), np.array([0]), np.array([[1.0, 1.0, 0.0]]), 30)
    assert np.allclose(pi, again[:, ::-1])


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(i, "kalo miru", f"l{i % 7}", "", 0.0) for i in range(40)]
    assert langid.train(spark.createDataFrame(rows, SCHEMA), most=5).languages == ["l0", "l1", "l2", "l3", "l4"]
