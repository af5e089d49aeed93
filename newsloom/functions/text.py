"""Text functions: Turkish lower-casing, cleaning, tokens. All are Column -> Column, but for NFKC, which Spark lacks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: HTML entities in the order in which they are decoded.
ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&apos;", "'"), ("&#8216;", "'"),
    ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&#8211;", "-"), ("&#8212;", "—"), ("&#8230;", "..."),
]

#: What marks a short line as advertising or page furniture.
AD_PATTERNS = [
    r"reklam", r"sponsor", r"advertisement", r"cookie", r"çerez politika", r"abone ol", r"bülten", r"haber bülten", r"sosyal medya", r"paylaş",
    r"yorum yap", r"yorum ekle", r"bu haberi oylayin", r"haberi değerlendir", r"önerilen haberler", r"ilgili haberler", r"daha fazla haber",
    r"tüm haberler", r"whatsapp", r"facebook", r"twitter", r"instagram", r"© \d{4}", r"tüm hakları saklıdır",
]

#: Python's white space.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def tr_lower(text: Column) -> Column:
    """Lower case with dotted and dotless i kept apart; null becomes empty.

    A replacement for each letter goes over bytes; Spark's translate looks up every letter of a text by itself.
    """
    text = F.coalesce(text, F.lit(""))
    for upper, lower in zip("IİĞÜŞÖÇ", "ıiğüşöç", strict=True):
        text = F.replace(text, F.lit(upper), F.lit(lower))
    return F.lower(text)


def py_trim(text: Column) -> Column:
    """Trim everything that Unicode calls white space. Only the ends are looked at."""
    return F.btrim(text, F.lit(SPACES))


def py_lines(text: Column) -> Column:
    """Split at line ends as Python's splitlines does; a last line end opens no line."""
    return F.split(F.regexp_replace(text, r"(?:\r\n|[\n\x{B}\x{C}\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}])$", ""), r"\r\n|[\n\x{B}\x{C}\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]")


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII texts, which it leaves alone, are not sent to Python."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.coalesce(F.when(ascii_only, text), _nfkc(F.when(~ascii_only, text)))


def strip_html_tags(text: Column) -> Column:
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"<[^>]+>"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def decode_entities(text: Column) -> Column:
    """In order, so that a doubly encoded entity is decoded twice."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def remove_ad_lines(text: Column, patterns: list[str] | None = None, longest: int = 200) -> Column:
    """Trim lines, drop empty ones and short ones that match a pattern."""
    pattern = "(?iuUd)" + "|".join(AD_PATTERNS if patterns is None else patterns)
    lines = F.transform(py_lines(text), py_trim)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~((F.length(x) <= longest) & x.rlike(pattern))), "\n")


def clean_special(text: Column) -> Column:
    text = F.regexp_replace(text, r"\.{3,}", "...")
    text = F.regexp_replace(F.regexp_replace(text, r"-{2,}", "-"), r"_{2,}", "_")
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def normalize_ws(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), " {2,}", " "), r"\n{3,}", "\n\n")


def clean(text: Column, patterns: list[str] | None = None, compose: bool = True) -> Column:
    """NFKC (unless ``compose`` is off), tags, entities, advertising lines, special characters, white space."""
    text = F.coalesce(text, F.lit(""))
    text = nfkc(text) if compose else text
    return py_trim(normalize_ws(clean_special(remove_ad_lines(decode_entities(strip_html_tags(text)), patterns))))


def title_tokens(title: Column) -> Column:
    """The set of words longer than two letters of a lower-cased title."""
    words = F.split(F.regexp_replace(tr_lower(title), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def title_ok(title: Column, least: int = 5) -> Column:
    """Long enough, and not a notice that scripts are off."""
    return (F.length(F.coalesce(title, F.lit(""))) >= least) & ~F.contains(F.lower(title), F.lit("javascript"))
