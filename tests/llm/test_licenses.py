import re

import pytest

from newsloom.llm import licenses

SCHEMA = "doc_id long, text string, unit string, n string"
NOTICES = {"a": "Use of this text is free for all people.", "b": "Use of this text is free for some people.", "c": "one", "long": " ".join(f"w{i}" for i in range(60))}


def grams(text):
    ws = re.findall("[a-z0-9]+", "".join(c.lower() if c < "\x80" else c for c in text))
    return set(zip(ws, ws[1:], strict=False))


def words(text):
    return re.findall("[a-z0-9]+", "".join(c.lower() if c < "\x80" else c for c in text))


def brute(docs, notices, threshold):
    out = []
    for doc_id, text in docs:
        lines, mine = (text or "").split("\n"), []
        for unit, line in enumerate([text or "", *lines] if len(lines) > 1 else [text or ""]):
            own, found = grams(line), []
            for name, notice in notices.items():
                other = grams(notice)
                if own and other and 2 * len(own & other) / (len(own) + len(other)) >= threshold:
                    found.append((-2 * len(own & other) / (len(own) + len(other)), name))
            if found:
                mine.append((doc_id, unit, min(found)[1], -min(found)[0]))
        ws = words(text or "")
        pairs = list(zip(ws, ws[1:], strict=False))
        for name, notice in notices.items():
            other, t = grams(notice), words(notice)
            listed = list(zip(t, t[1:], strict=False))
            if not other or any(x[2] == name for x in mine):
                continue
            starts = {max(i - listed.index(p), 0) for i, p in enumerate(pairs) if p in other}
            dice = max((2 * len(set(pairs[s : s + len(t) - 1]) & other) / (len(set(pairs[s : s + len(t) - 1])) + len(other)) for s in starts), default=0)
            if dice >= threshold:
                mine.append((doc_id, -1, name, dice))
        out += mine
    return sorted(out, key=str)


@pytest.mark.parametrize("literals", [20_000, 3])
def test_equals_brute_force(spark, monkeypatch, literals):
    monkeypatch.setattr(licenses, "LITERAL_BIGRAMS", literals)
    docs = [
        (1, "intro\nUSE of this -- text is free, for all people!\nend"),
        (2, "Use of this text is free for most people."),
        (3, "Use of this text is free for all people and more words than the bound lets through for any short notice at all"),
        (4, NOTICES["long"].upper() + " extra"), (5, NOTICES["long"].replace(" w30", "\n w30")), (6, None), (7, ""), (8, "one"), (9, "\n\n"),
        (1, "Use of this text is free for all people."), (2, "Use of this text is free for most people."), (None, "use of this text is free for some people"),
        (10, "use of this text é is free for all people"), (11, "filler words " * 20000 + "\n" + NOTICES["b"]),
        (12, "some words before\nUse of this\ntext is free\nfor all people. And after it " + NOTICES["long"].replace(" w20 ", "\nextra ") + " the end"), (12, None),
        (13, "all people use of this text and for all of this is free"), (14, "x " + NOTICES["a"] + " y\nz"), (14, "x " + NOTICES["a"] + " y\nz"),
    ]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA)
    for threshold in (0.8, 0.6):
        got = licenses.scan(df, NOTICES, threshold)
        assert got.columns == ["doc_id", "unit", "license_id", "dice"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, NOTICES, threshold)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "Released under the MIT License.", "", "")], SCHEMA)
    assert licenses.scan(none).count() == 0
    assert licenses.scan(one, {"c": "one"}).count() == 0
    assert [r.license_id for r in licenses.scan(one).collect()] == ["MIT"]


def test_whole_licences_wrapped_over_lines(spark):
    import textwrap

    rows = [(i, "/*\n" + textwrap.fill(licenses.NOTICES[name], 70, initial_indent=" * ", subsequent_indent=" * ") + "\n */\nint main() { return 0; }\n" * 200, name, "") for i, name in enumerate(sorted(licenses.NOTICES))]
    got = {(r.doc_id, r.license_id): r.dice for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {name: got.get((i, name), 0) for i, _, name, _ in rows if got.get((i, name), 0) < 0.8} == {}
