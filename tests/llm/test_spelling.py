import random
import re
import zlib
from collections import Counter

from newsloom.llm import spelling

DOCS = "doc_id long, text string, word string, n string"
WORDS = "word string, n long"


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def plain_counts(docs, least=5, every=199):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= least}


def plain_forms(words, ratio=5):
    letters = {c for w in words for c in w}
    out, form = {}, {}
    for w, n in words.items():
        near = [x for x in edits(w, letters) if x in words]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
        out[w] = [n, len(near), words[form[w]] if form[w] else None]
    rows = []
    for w, (n, n_near, form_n) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, n_near, form_n))
    return sorted(rows)


def forms_of(found):
    return sorted(tuple(r) for r in found.collect())


def test_trie_finds_all_neighbours():
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(600)}
    trie = spelling.Trie([(w, i) for i, w in enumerate(sorted(words))])
    for w in [*words, "", "zz", "abababababab"]:
        assert set(trie.near(w)) == edits(w, "abé") & words, w
    assert all(trie.near(w)[x] == sorted(words).index(x) for w in list(words)[:50] for x in trie.near(w))


def test_counts(spark):
    rng = random.Random(4)
    known = ["Straße", "Élevées", "letters", "naïveté", "ÀÁÂÃÄÅ", "a×b÷c÷d", "UPPERcase", "yÿyÿyÿ", "ŁódźŁódź"]
    docs = [(i, " ".join(rng.choice(known) + rng.choice(["", ".", "1", "İ", "日本", "\n"]) for _ in range(60))) for i in range(120)]
    docs += [(None, "letters letters"), (1, None), (2, ""), (5, docs[5][1]), (7, "long" * 20_000 + " " + "letters " * 5_000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    got = {r.word: r.n for r in spelling.word_counts(df.repartition(5), every=7).collect()}
    assert got == plain_counts(docs, every=7)
    assert {r.word: r.n for r in spelling.word_counts(df, every=7).collect()} == got
    assert spelling.word_counts(df.limit(0)).count() == 0


def test_forms_chains_and_ties(spark):
    words = {"banana": 5, "bananas": 25, "bananass": 125, "bananassy": 625, "cherry": 30, "cherrx": 6, "cherre": 30, "single": 9, "singles": 44, "doublé": 50, "double": 10, "doubl": 50}
    df = spark.createDataFrame(list(words.items()), WORDS)
    want = plain_forms(words)
    got = forms_of(spelling.spelling_forms(df))
    assert got == want
    by = {r[0]: r for r in got}
    assert by["banana"][2] == "bananassy" and by["cherrx"][1] == "cherre" and by["single"][1] is None and by["double"][1] == "doubl"
    # Shards of three words at most, waves of six.
    assert forms_of(spelling.spelling_forms(df, shard=3, wave=6, task=4)) == want
    assert forms_of(spelling.spelling_forms(df.limit(0))) == []


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert forms_of(spelling.op12_spelling(spark, "/root/testdata/sf0.001")) == plain_forms(plain_counts(rows))
