import datetime as dt
import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import dates, similarity, text


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tr_lower(spark):
    assert column(spark, ["YANGIN", "İZMİT", "ISPARTA", None, "ÇĞÜ Şö"], text.tr_lower) == ["yangın", "izmit", "ısparta", "", "çğü şö"]


CLEAN = [
    ("a &amp;lt; b", "a < b"),
    ("&lt;b&gt;x&lt;/b&gt;", "<b>x</b>"),
    ("Haber\nWhatsApp ihbar hattı\nSon", "Haber\nSon"),
    ("a.....b---c___d", "a...b-c_d"),
    ("whatsapp " + "x" * 200, "whatsapp " + "x" * 200),
    ("<style>p{}</style><p>Bir</p>\t\t<script>\nx()\n</script>iki", "Bir iki"),
    ("ﬁn ①", "fin 1"),
    (None, ""),
    ("   x  ", "x"),
    ("bir\r\niki üç", "bir\niki\nüç"),
    ("TÜM HABERLER", ""),
]


def test_clean(spark):
    assert column(spark, [a for a, _ in CLEAN], text.clean) == [b for _, b in CLEAN]


def test_nfkc_equals_the_standard_library(spark):
    values = ["ascii", "ｆｕｌｌ", "é", None, "½ ㎏"]
    assert column(spark, values, text.nfkc) == [v and unicodedata.normalize("NFKC", v) for v in values]


def test_title_gate(spark):
    assert column(spark, ["abcd", "JavaScript gerekli", "abcde", None], text.title_ok) == [False, False, True, False]


DATES = [
    ("2025-03-04T10:20:30Z", (2025, 3, 4, 10, 20, 30)), ("2025-03-04T10:20:30+03:00", (2025, 3, 4, 7, 20, 30)), ("2025-03-04 10:20", (2025, 3, 4, 10, 20)),
    ("2025-03-04", (2025, 3, 4)), ("2025-03-04 sonra", (2025, 3, 4)), ("Eklenme 4.3.2025 09:05", (2025, 3, 4, 9, 5)), ("4 Ağustos 2025 9:05", (2025, 8, 4, 9, 5)),
    ("4 August 2025", (2025, 8, 4)), ("4 NİSAN 2025", None), ("31.02.2025", None), ("", None), (None, None), ("4 Foo 2025", None), ("2025-13-40", None),
]


def test_dates(spark):
    assert column(spark, [a for a, _ in DATES], lambda c: dates.try_parse(c)) == [b and dt.datetime(*b) for _, b in DATES]


URLS = [("/a/2025/3/4/x", (2025, 3, 4)), ("/x-04-03-2025.html", (2025, 3, 4)), ("/x-04-03-1999.html", None), ("/a/2025/13/4/", None), ("/2025/02/30/x-01.02.2024", (2024, 2, 1)), ("", None), (None, None)]


def test_url_dates(spark):
    assert column(spark, [a for a, _ in URLS], dates.date_from_url) == [b and dt.datetime(*b) for _, b in URLS]


def test_similarities(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r[0] for r in df.select(similarity.cosine(F.col("a"), F.col("b"))).collect()] == [1, 0, 0]
    titles = [("TEM Otoyolunda zincirleme kaza", "TEM otoyolunda zincirleme kaza: 3 yaralı"), ("", "x"), ("abc", "abc")]
    df = spark.createDataFrame(titles, "a string, b string")
    got = [r[0] for r in df.select(similarity.jaccard(text.title_tokens(F.col("a")), text.title_tokens(F.col("b")))).collect()]
    assert got == pytest.approx([0.8, 0, 1])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=30), st.text(max_size=30)), min_size=1, max_size=20))
def test_properties(spark, pairs):
    pairs = [(a.replace("\x00", ""), b.replace("\x00", "")) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a string, b string")
    j = lambda x, y: similarity.jaccard(text.title_tokens(F.col(x)), text.title_tokens(F.col(y)))
    once = text.tr_lower(F.col("a"))
    for r in df.select(j("a", "b").alias("ab"), j("b", "a").alias("ba"), once.alias("l"), text.tr_lower(once).alias("ll")).collect():
        assert r.ab == r.ba and 0 <= r.ab <= 1 and not math.isnan(r.ab) and r.l == r.ll


def test_lower_case_goes_by_bytes_not_by_letters(spark):
    rows = spark.createDataFrame([("IİĞÜŞÖÇ Işık İl ÄÉ",), (None,), ("",)], "t string").select(text.tr_lower(F.col("t")).alias("t"))
    assert [r.t for r in rows.collect()] == ["ıiğüşöç ışık il äé", "", ""]
    assert "translate(" not in rows._jdf.queryExecution().optimizedPlan().toString()
