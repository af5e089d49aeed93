"""The rules of context: the guard graph against plain evaluation, and hand-derived scores."""

import random
import re

import pytest

from newsloom.operators import scoring
from newsloom.profiles import TURKISH
from newsloom.rules import CONTEXT_RULES, Rule

T, Y, E, S, H, K = TURKISH.categories


def plain(text, rules):
    """Deltas by category, one rule after the other."""
    out, used = dict.fromkeys(TURKISH.categories, 0), set()
    for r in rules:
        found = lambda p: re.search(p, text) is not None
        if all(map(found, r.must)) and not any(map(found, r.must_not)) and r.group not in used and not any(found(a) and not found(b) for a, b in r.unless):
            used |= {r.group} - {""}
            for c, d in r.deltas:
                out[c] += d
    return out


def deltas(spark, texts, rules):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string").selectExpr("doc_id", "cast(null as string) title", "body")
    got = {r.id: r for r in scoring.rule_deltas(docs, rules, TURKISH.categories).collect()}
    return [{c: got[i][f"delta_{k}"] for k, c in enumerate(TURKISH.categories)} for i in range(len(texts))]


def only(**by):
    return dict.fromkeys(TURKISH.categories, 0) | {{"T": T, "Y": Y, "E": E, "S": S, "H": H, "K": K}[k]: v for k, v in by.items()}


@pytest.mark.parametrize(("pattern", "want"), [
    ("abc|de+f", ["abc", "de"]), (r"a?bcd\s+xy", ["bcd"]), ("(?:ab|cd).{0,9}(?:efg|hij)", ["efg", "hij"]), (r"(?<![a-z])isu(?![a-z]).{0,6}x", ["isu"]), (r"\d+", None),
    ("[ab]c|d", ["c", "d"]), ("(?:abc)?x", ["x"]), ("licen[sc]ed under", ["ed under"]), ("kaza(?!n)", ["kaza"]), ("ab*", ["a"]),
])
def test_needed_literals(pattern, want):
    assert scoring.needed(pattern) == want


def test_needed_literals_hold_in_every_match():
    rng = random.Random(1)
    patterns = sorted({p for r in CONTEXT_RULES + TURKISH.rules for p in (*r.must, *r.must_not, *(x for pair in r.unless for x in pair))})
    words = sorted({w for p in patterns for w in scoring.needed(p) or []})
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", "  ", " 3 "]) for _ in range(4))
        for p in rng.sample(patterns, 8):
            if re.search(p, text) and scoring.needed(p) is not None:
                assert any(w in text for w in scoring.needed(p)), (p, text)


def test_graph_equals_plain_evaluation(spark):
    rng = random.Random(2)
    texts = ["", "hiçbir şey"]
    for r in CONTEXT_RULES:
        parts = [scoring.needed(p) for p in r.must]
        for _ in range(3):
            texts.append(" ".join(rng.choice(x) for x in parts))
            texts.append(" ".join([rng.choice(x) for x in parts] + [rng.choice(scoring.needed(rng.choice(CONTEXT_RULES).must[0])) for _ in range(3)]))
    texts += [
        "otoyol durdu", "tesis açılış töreni", "tahliye oldu, holding", "sinema salonlarında vizyona giren", "tem otoyolunda kaza", "otoyol zincirleme", "baro önünde yemin etti",
        "meslek lisesi sergiledi", "dolandırıldı, umre", "kbrn eğitim", "köprü bakım trafik", "hastane 112 günü", "turnuva, talihsiz kaza", "ameliyat", "tahliye edildi", "kamyon yola düştü",
        "yaşam mücadelesi", "cinayet, keşke", "sedaş çukur araç düştü", "sedaş sendika", "elektrik zam", "trafik sigorta", "müjde, rahatsız", "siber operasyonda tutuklandı",
    ]
    # Whole phrases too: each alternative without its odd characters.
    for p in {p for r in CONTEXT_RULES for p in r.must + r.must_not}:
        texts += [re.sub(r"\\s[+*]|\.\{0,\d+\}", " ", x) for x in p.split("|") if not set(re.sub(r"\\s[+*]|\.\{0,\d+\}", " ", x)) & set("()[]\\?")]
    got = deltas(spark, texts, CONTEXT_RULES)
    for text, d in zip(texts, got, strict=True):
        assert d == plain(text, CONTEXT_RULES), text
    fired = {r.name for r in CONTEXT_RULES for t in texts if plain(t, (r,)) != only()}
    assert len(fired) == len(CONTEXT_RULES), {r.name for r in CONTEXT_RULES} - fired


def test_hand_derived_deltas(spark):
    cases = [
        ("tem otoyolunda feci kaza", only(Y=-450 - 780, T=28 + 60)),  # R1, R48
        ("tem otoyolunda feci kaza, araç alev aldı", only(Y=-780, T=60)),  # fire: no R1
        ("su kesintisi yaşanacak", only(E=-500)),
        ("kesintisiz hizmet", only(E=-100)),
        ("güneş enerji santral ile elektrik üretildi", only(E=-500)),  # R4, its first part only
        ("elektrik üretildi, elektrik kesintisi de var", only(E=-120)),  # a cut is named: the second part
        ("katliam", only(T=-120, H=-100)),  # R13, R14
        ("katliam ve soygun", only(T=-120)),
        ("operasyonda gözaltı", only(H=-120 - 450, S=24)),  # R31, R32
        ("operasyonda gözaltı, market soygun", only(S=24)),
        ("futbol", only(T=-200, Y=-200, E=-200, S=-200, H=-200, K=-200)),
        ("futbol, kesinti", only()),
        ("hava durumu", only(T=-150, Y=-150, E=-150, S=-150, H=-150, K=-150 - 260)),
        ("hava durumu, tiyatro", only(T=-150, Y=-150, E=-150, S=-150, H=-150, K=-150)),
        ("konser", only(T=-160, S=-100, K=-200)),  # R9: it holds "ons"
        ("sivil savunma tatbikat", only(Y=-720, K=62)),
        ("sivil savunma", only(Y=-720, K=-100)),
        ("tüpraş fidan dikti", only(Y=-520, E=-620, K=52)),  # R44, R45
        ("fidan dikildi, duman", only()),
        ("tüpraş fidan dikti, duman", only(Y=-520, E=-620, K=52)),
        ("nöbetçi eczane", only(K=-520)),
    ]
    assert deltas(spark, [t for t, _ in cases], CONTEXT_RULES) == [d for _, d in cases]
    assert [plain(t, CONTEXT_RULES) for t, _ in cases] == [d for _, d in cases]


def test_classify_with_the_turkish_profile(spark):
    lexicon = spark.createDataFrame([(T, "kaza", 5), (Y, "yangın", 6), (K, "konser", 7), (E, "kesinti", 4), (H, "hırsız", 6)], "category string, keyword string, weight int")
    rows = [
        (1, "Otoyolda zincirleme kaza", "Otoyolda zincirleme kaza, yangın sanıldı"),  # T 5*(2+1)+14+60+35, Y 6+0-780-520 -> 0
        (2, "Konser", "Konser ve nöbetçi eczane listesi"),  # K 7*3+4-520 -> 0: no category
        (3, "Su kesintisi", "Mahallede kesinti"),  # E 4*3-500 -> 0: no category
        (4, "YANGIN ÇIKTI", "itfaiye geldi"),  # Y 6*2+11
        (5, "", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string")
    got = {r.id: (r.category, r.score) for r in scoring.classify(docs, lexicon, TURKISH).collect()}
    assert got == {1: (T, 5 * 3 + 14 + 60 + 35 + 28 * 0), 2: (None, 0), 3: (None, 0), 4: (Y, 23), 5: (None, 0)}


def test_groups_and_shared_guards(spark):
    rules = (Rule("a", ("xx",), ((T, 1),), group="g"), Rule("b", ("xx|yy",), ((T, 10),), group="g"), Rule("c", ("xx",), ((Y, 5), (T, 100)), ("zz",)))
    assert deltas(spark, ["xx", "yy", "xx zz", "none"], rules) == [only(T=101, Y=5), only(T=10), only(T=1), only()]
    assert deltas(spark, ["xx"], ()) == [only()]
    rules = (Rule("a", ("xx",), ((T, 1),), unless=(("made", "cut"),)),)
    assert deltas(spark, ["xx", "xx made", "xx made cut", "xx cut"], rules) == [only(T=1), only(), only(T=1), only(T=1)]
