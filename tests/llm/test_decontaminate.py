import hashlib
import random
import re

import pytest

from newsloom.llm import decontaminate

SCHEMA = "doc_id long, text string, win string, pos int, items string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        words = WORD.findall(lower(text))
        hit, found = set(), set()
        for item_id, item in items:
            own = WORD.findall(lower(item))
            for i in range(max(len(own) - window, 0) + 1 if own else 0):
                win = own[i : i + window]
                for p in range(len(words) - len(win) + 1):
                    if words[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(item_id)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def fixture(seed=4):
    rng = random.Random(seed)
    vocab = ["the", "of", "É", "é", "x1", "zebra", "Q"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([13, 20, 40]))) for i in range(10)] + [(20, "short one here"), (21, "two words"), (22, "Zebra"), (23, ""), (24, None), (25, "w1, w2; W3 w4 w5!"), (None, text(14))]
    items.append((30, items[0][1]))
    docs = [(i, text(60)) for i in range(20)]
    for i in range(20, 50):
        item = rng.choice(items)[1] or ""
        words = text(40).split()
        at = rng.randrange(40)
        docs.append((i, " ".join(words[:at]) + "... " + item.upper().replace(" ", " -- ") + "\n" + " ".join(words[at:])))
    docs += [(100, None), (101, ""), (102, "!!! ..."), (100, docs[25][1]), (20, docs[20][1]), (None, docs[22][1]), (103, (items[1][1] + " ") * 300)]
    return docs, items


@pytest.mark.parametrize("bound", [200_000, 7])
def test_equals_brute_force(spark, bound):
    docs, items = fixture()
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, bench, broadcast_windows=bound).drop("text_hash")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_removal(spark):
    docs, items = fixture()
    items = [i for i in items if i[1] and len(i[1].split()) > 12]
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    flags = {(d, n): c for d, n, _, _, _, c in brute(docs, items)}
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns
    key = lambda d, t: (d, len(WORD.findall(lower(t))))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(d) for d in docs if not flags[key(*d)])
    cut = decontaminate.decontaminate(df, bench, remove="spans")
    rows = [(r.doc_id, r.text) for r in cut.collect()]
    assert cut.columns == df.columns and len(rows) == len(docs)
    assert (0, docs[0][1]) in rows and (100, None) in rows and (102, "!!! ...") in rows
    longest = next(t for d, t in rows if d == 103)
    assert WORD.findall(lower(longest)) == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    one = spark.createDataFrame([(1, "a b", "", 0, "")], SCHEMA)
    row = decontaminate.contamination(one, bench).collect()[0]
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


@pytest.mark.parametrize("bound", [200_000, 7])
def test_items_that_begin_alike(spark, bound):
    """Windows of one opening are told apart by the whole of them: a position of the opening meets its own alone."""
    opening = "a b c d e f g h i j k l"
    items = [(i, f"{opening} end{i}") for i in range(300)] + [(400, "a b c d"), (401, "a b c d e")]
    docs = [(i, f"{opening} end{i} " * 3 + f"{opening} other") for i in range(5)] + [(9, opening)]
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, bench, broadcast_windows=bound).drop("text_hash")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)
    wins = decontaminate.benchmark_windows(bench)
    assert wins.select("h").distinct().count() == wins.count() == 302
