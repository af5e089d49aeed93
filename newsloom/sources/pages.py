"""Articles, links and classes from HTML pages.

The parser runs once for a page, in an Arrow-batched UDF that returns every candidate (content by tier, dates by tier,
links); choosing among candidates, parsing dates and filtering are columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.dates import date_from_url, try_parse
from newsloom.operators import graph
from newsloom.sources.dom import Node, parse

#: Where articles keep their text, dates and descriptions.
CONTENT_CLASSES = [
    "news-detail-content", "news-content", "haber-detay-icerik", "haber-metni", "haber_metni", "haberMetni", "detay-icerik", "article-body",
    "entry-content", "post-content", "content-text", "news-text",
]
CONTENT_PATTERN = re.compile(
    r"news[-_]?detail|haber[-_]?detay|haber[-_]?metin|article[-_]?body|entry[-_]?content|post[-_]?content|content[-_]?text|news[-_]?text|detail[-_]?content|icerik|article",
    re.IGNORECASE,
)
JSON_DATES = ("datePublished", "dateCreated", "uploadDate", "dateModified")
META_DATES = [
    ("property", "article:published_time"), ("property", "og:published_time"), ("property", "og:updated_time"), ("name", "datePublished"), ("name", "pubdate"),
    ("name", "publish-date"), ("name", "date"), ("name", "DC.date.issued"), ("name", "parsely-pub-date"),
]
DESCRIPTIONS = [("property", "og:description"), ("name", "description"), ("name", "twitter:description")]
#: Of each selector the first element counts: a class of this name, then a class attribute that holds this text.
DATE_CLASSES = ["haber-tarih", "news-date", "post-date", "article-date", "published", "tarih", "info", "date", "pub-date", "time"]
DATE_PARTS = ["date", "time"]

_HIDDEN = frozenset({"script", "style", "noscript", "iframe", "button"})
_BLANK = {"A A", "A  A", "AA"}
STRINGS = T.ArrayType(T.StringType())
PARSED = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("h1", "selector", "by_class", "paragraphs", "description")],
    *[T.StructField(c, STRINGS) for c in ("json_dates", "meta_dates", "time_dates", "class_dates")],
])


def _tag_text(node: Node) -> str:
    text = " ".join(node.text(" ", _HIDDEN).split())
    return "" if text in _BLANK else text


def _with_year(text: str) -> str:
    return text if re.search(r"\d{4}", text) else ""


def _json_dates(data: object) -> Iterator[str]:
    """Dates of a JSON-LD value, an object's own before those below it."""
    stack = [data]
    while stack:
        item = stack.pop()
        if isinstance(item, dict):
            yield from (item[k] for k in JSON_DATES if isinstance(item.get(k), str) and item[k].strip())
            stack += reversed(list(item.values()))
        elif isinstance(item, list):
            stack += reversed(item)


def parse_page(html: str | None, least: int = 60, closed: bool = False) -> dict:
    """All candidates of one page. Texts count as content with more than ``least`` characters; ``closed`` as in ``parse``."""
    nodes = list(parse(html, closed).walk())
    of = lambda *tags: [n for n in nodes if n.tag in tags]
    metas, divs = of("meta"), of("div")

    def meta(attr: str, key: str) -> Node | None:
        return next((m for m in metas if m.attrs.get(attr) == key), None)

    def selected() -> Iterator[Node]:
        for name in CONTENT_CLASSES:
            yield from [d for d in divs if name in d.classes][:1]
        yield from [d for d in divs if d.attrs.get("itemprop") == "articleBody"][:1]
        yield from of("article")[:1]

    def dated() -> Iterator[Node | None]:
        for name in DATE_CLASSES:
            yield next((n for n in nodes if name in n.classes), None)
        for part in DATE_PARTS:
            yield next((n for n in nodes if part in n.attrs.get("class", "")), None)

    long = lambda texts, least: next((t for t in texts if len(t) > least), None)
    paragraphs = [t for t in (p.text() for p in of("p")) if len(t) > 30 and "cookie" not in t.lower()]
    found_json = []
    for script in of("script"):
        if "ld+json" in script.attrs.get("type", "").lower():
            try:
                found_json += list(_json_dates(json.loads("".join(script.strings()).strip() or "null")))
            except ValueError:
                continue
    h1 = of("h1")
    descriptions = ((m.attrs.get("content") or "").strip() for m in (meta(*d) for d in DESCRIPTIONS) if m)
    return {
        "h1": h1[0].text() if h1 else None,
        "selector": long((_tag_text(n) for n in selected()), least),
        "by_class": long((_tag_text(d) for d in divs if CONTENT_PATTERN.search(d.attrs.get("class", "") + " " + d.attrs.get("id", ""))), least),
        "paragraphs": long([" ".join(paragraphs)], least),
        "description": long(descriptions, 15),
        "json_dates": found_json,
        "meta_dates": [m.attrs["content"] for m in (meta(*d) for d in META_DATES) if m and m.attrs.get("content")],
        "time_dates": [x for t in of("time") for x in ((t.attrs.get("datetime") or "").strip(), _with_year(t.text(" "))) if x],
        "class_dates": [n.text(" ") for n in dated() if n],
    }


def _parsed(least: int, closed: bool):
    @F.pandas_udf(PARSED)
    def parsed(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(h, least, closed) for h in html], columns=PARSED.fieldNames())

    return parsed


def _first_date(texts: Column) -> Column:
    return F.get(F.filter(F.transform(texts, lambda x: try_parse(x)), lambda d: d.isNotNull()), F.lit(0))


def parse_articles(pages: DataFrame, html_col: str = "html", url_col: str = "url", least: int = 60, closed: bool = False) -> DataFrame:
    """``pages`` with title, content, published_at; pages without an h1 are dropped.

    Content is the first tier that has enough text: selectors, classes, paragraphs, description, title. The date is the
    first that parses of JSON-LD, meta, time elements, date classes and the address of the page. ``least`` is the length
    that the first three tiers must exceed; with ``closed`` references without a semicolon stay as they are written.
    """
    out = pages.withColumn("_p", _parsed(least, closed)(F.col(html_col))).where("_p.h1 is not null")
    content = F.coalesce("_p.selector", "_p.by_class", "_p.paragraphs", F.when(F.length("_p.description") > 20, F.col("_p.description")), "_p.h1")
    dates = [_first_date(F.col(f"_p.{c}")) for c in ("json_dates", "meta_dates", "time_dates", "class_dates")]
    out = out.withColumns({"title": F.col("_p.h1"), "content": content, "published_at": F.coalesce(*dates, date_from_url(F.col(url_col)))})
    return out.drop("_p")


@F.pandas_udf(STRINGS)
def _hrefs(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [x for x in ((n.attrs.get("href") or "").strip() for n in parse(h).find("a")) if x and not x.startswith("#") and "javascript:" not in x.lower()])


@F.pandas_udf(STRINGS)
def _classes(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [c for n in parse(h).walk() for c in n.classes])


@F.pandas_udf(STRINGS)
def _absolute(hrefs: pd.Series, base: pd.Series) -> pd.Series:
    def one(href: str, base_url: str) -> str:
        try:
            return urldefrag(urljoin(base_url.rstrip("/") + "/", href)).url.rstrip("/")
        except ValueError:
            return ""

    return pd.Series([[one(h, b) for h in hs] for hs, b in zip(hrefs, base, strict=True)], dtype=object)


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, pos, href: links of each page as written, without empty ones, fragments and scripts."""
    links = pages.select(F.col(id_col).alias("id"), F.posexplode_outer(_hrefs(F.col(html_col))).alias("pos", "href"))
    return links.where("href is not null")


def collect_links(pages: DataFrame, pattern: str, base_col: str, most: int = 120, fetches: int = 48, failures: int = 12, idle: int = 10, order_col: str = "page_id", html_col: str = "html", source_col: str | None = None, pattern_col: str | None = None) -> DataFrame:
    """source, url, ord: distinct article addresses of each source in order of discovery, ``most`` at most.

    Addresses hold ``pattern`` (or that of ``pattern_col``). Listing pages are read in order, ``fetches`` at most. One counter runs over pages without HTML (failures) and pages
    without a new address (idle ones) and starts again at a page with one; reading stops at a failure if it has come to
    ``failures``, at an idle page if it has come to ``idle``.
    """
    from pyspark.sql import Window

    graph.checkpoint_folder(pages.sparkSession)
    source = F.col(source_col) if source_col else F.lit("")
    listing = pages.select(source.alias("source"), F.col(order_col).alias("page"), F.col(base_col).alias("base"), F.col(html_col).alias("html"), F.concat(F.lit("(?dU)"), F.col(pattern_col) if pattern_col else F.lit(pattern)).alias("pattern"))
    listing = listing.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("page"))).where(F.col("turn") <= fetches)
    urls = _absolute(F.coalesce(_hrefs(F.coalesce("html", F.lit(""))), F.array().cast("array<string>")), F.col("base"))
    own = F.filter(urls, lambda u: F.startswith(u, F.regexp_replace("base", "/+$", "")) & F.regexp(u, F.col("pattern")))
    listing = listing.withColumns({"failed": F.col("html").isNull(), "urls": own}).drop("html", "pattern").checkpoint()
    seen = listing.select("source", "turn", F.posexplode("urls").alias("pos", "url"))
    first = seen.groupBy("source", "url").agg(F.min(F.struct("turn", "pos")).alias("at"))
    fresh = first.groupBy("source", "at.turn").agg(F.count("*").alias("fresh"))
    pages_ = listing.select("source", "turn", "failed").join(fresh, ["source", "turn"], "left")
    upto = Window.partitionBy("source").orderBy("turn")
    good = F.max(F.when(F.col("fresh") > 0, F.col("turn"))).over(upto)
    streak = pages_.withColumn("streak", F.col("turn") - F.coalesce(good, F.lit(0)))
    enough = F.col("streak") >= F.when(F.col("failed"), failures).otherwise(idle)
    stop = streak.where(enough).groupBy("source").agg(F.min("turn").alias("last"))
    found = first.join(stop, "source", "left").where("last is null or at.turn <= last")
    order = F.row_number().over(Window.partitionBy("source").orderBy("at.turn", "at.pos"))
    return found.select("source", "url", order.alias("ord")).where(F.col("ord") <= most)


def link_profile(links: DataFrame, host: str, segments: tuple[int, ...] = (5, 6)) -> DataFrame:
    """How many distinct addresses of the host have at least so many parts between slashes."""
    own = links.where(F.startswith("url", F.lit(host)))
    return own.agg(*[F.count_distinct(F.when(F.size(F.split("url", "/")) >= n, F.col("url"))).alias(f"n_{n}") for n in segments])


def class_topk(pages: DataFrame, k: int = 10, html_col: str = "html") -> DataFrame:
    """class, n: the most frequent CSS classes."""
    return pages.select(F.explode_outer(_classes(F.col(html_col))).alias("class")).where("class is not null").groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(k)


def expand_pagination(urls: DataFrame, most: int = 3, url_col: str = "url") -> DataFrame:
    """url, ord: each listing address, then its pages 2 .. most by two parameters; each address once, in order."""
    base = F.regexp_replace(url_col, "/+$", "")
    glue = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    pages = F.transform(F.sequence(F.lit(2), F.lit(most)), lambda n: F.array(F.concat(base, glue, F.lit("page="), n.cast("string")), F.concat(base, glue, F.lit("sayfa="), n.cast("string"))))
    listed = F.concat(F.array(base), F.flatten(pages) if most >= 2 else F.array().cast("array<string>"))
    out = urls.select("ord", F.posexplode(listed).alias("pos", "url")).groupBy("url").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return out.select("url", F.col("at.ord").alias("ord"), F.col("at.pos").alias("pos"))


__all__ = ["class_topk", "collect_links", "expand_pagination", "link_profile", "page_links", "parse_articles", "parse_page"]
