"""Filtered listings, statistics and counters over a news table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, LARGEST_LIMIT = 500, 1000


def limit_policy(limit: int | None) -> int:
    return min(DEFAULT_LIMIT if limit is None else int(limit), LARGEST_LIMIT)


def fetch_cap(limit: int, post_filters: bool) -> int:
    """How many rows the capped listing reads before it filters."""
    return min(max(25 * limit, 500), 8000) if post_filters else limit


def date_bounds(date_from: str | None, date_to: str | None, as_of: dt.datetime, days: int = 3) -> tuple[dt.datetime | None, dt.datetime | None]:
    """No start: ``days`` before ``as_of``; a start that is no date: none. The end is the midnight after its day, included."""

    def parsed(text: str) -> dt.datetime | None:
        try:
            return dt.datetime.strptime(text, "%Y-%m-%d")
        except ValueError:
            return None

    start = as_of - dt.timedelta(days=days) if not date_from else parsed(date_from)
    end = parsed(date_to) if date_to else None
    return start, end and end + dt.timedelta(days=1)


def query_news(
    news: DataFrame,
    category: str | None = None,
    district: str | None = None,
    date_from: dt.datetime | None = None,
    date_to: dt.datetime | None = None,
    has_location: bool = False,
    limit: int | None = None,
    capped: bool = False,
    order: tuple[str, str] = ("published_at", "_id"),
) -> DataFrame:
    """The latest news that match, without embeddings.

    Filters stand below the sort, where Catalyst pushes them into the scan. ``capped`` reads the latest rows first, as a
    store does that cannot filter ranges, and filters what it got: narrow old ranges may then come out empty.
    """
    n = limit_policy(limit)
    latest = lambda df, k: df.orderBy(F.desc_nulls_last(order[0]), order[1]).limit(k)
    ranged = date_from is not None or date_to is not None or has_location
    if category:
        news = news.where(F.col("category") == category)
    if district:
        news = news.where(F.col("location.district") == district)
    if capped and ranged:
        news = latest(news, fetch_cap(n, True))
    if date_from is not None:
        news = news.where(F.col(order[0]) >= F.lit(date_from))
    if date_to is not None:
        news = news.where(F.col(order[0]) <= F.lit(date_to))
    if has_location:
        news = news.where("location.lat is not null")
    return latest(news, n).drop("embedding")


def get_news(news: DataFrame, _id: str) -> DataFrame:
    return news.where(F.col("_id") == _id).drop("embedding")


def recent(articles: DataFrame, cutoff: dt.datetime, ts: str = "published_at") -> DataFrame:
    """Rows dated at the cutoff or later; undated ones go."""
    return articles.where(F.col(ts) >= F.lit(cutoff))


def multi_source(news: DataFrame) -> DataFrame:
    return news.where(F.size("sources") > 1)


def stats(news: DataFrame) -> DataFrame:
    """kind, key, n: total, mapped, by_category and by_source, all in one scan.

    Rows become at most four (kind, key) pairs, so the aggregate's partial step leaves a few rows for each task.
    """
    pairs = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("key")),
        F.when(F.col("location.lat").isNotNull(), F.struct(F.lit("mapped").alias("kind"), F.lit("").alias("key"))),
        F.struct(F.lit("by_category").alias("kind"), F.coalesce(F.nullif("category", F.lit("")), F.lit("Diger")).alias("key")),
        F.when(F.size("sources") > 0, F.struct(F.lit("by_source").alias("kind"), F.coalesce(F.get("sources", F.lit(0))["source_name"], F.lit("Bilinmeyen")).alias("key"))),
    )
    return news.select(F.explode(pairs).alias("p")).where("p is not null").groupBy("p.kind", "p.key").agg(F.count("*").alias("n"))


def stats_by(news: DataFrame) -> DataFrame:
    """category, source, day, level, n: counts by category and first source, by each alone, by day, and of all.

    ``level`` tells the groupings apart: 1, 2 and 4 for a missing day, source and category, added up (as GROUPING_ID), so a
    null key of a grouping differs from a key that it lacks. One scan; each task's partial step leaves a row for each
    distinct key. News without a source count under none (null), those without a category as in ``stats``.
    """
    keys = news.select(
        F.coalesce(F.nullif("category", F.lit("")), F.lit("Diger")).alias("category"),
        F.when(F.size("sources") > 0, F.coalesce(F.get("sources", F.lit(0))["source_name"], F.lit("Bilinmeyen"))).alias("source"),
        F.to_date("published_at").alias("day"),
    )
    c, s, d = F.col("category"), F.col("source"), F.col("day")
    return keys.groupingSets([[c, s], [c], [s], [d], []], c, s, d).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


OUTCOMES = ("saved", "duplicate", "no_category", "no_location", "geocode_failed", "errors")


def run_counters(outcomes: DataFrame, extra: Column | None = None) -> DataFrame:
    """One row of counters over an ``outcome`` column."""
    counted = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return outcomes.agg(F.count("*").alias("scraped"), *counted, *([] if extra is None else [F.count_if(extra).alias("geocode_fallback")]))


def source_links(news: DataFrame) -> DataFrame:
    """Add ``links``: the distinct sources by address and by name in order, the article's own first if its name is new."""
    blank = F.lit("")
    own = F.struct(F.coalesce(F.get("sources", F.lit(0))["source_name"], blank).alias("name"), F.coalesce("url", blank).alias("url"))
    listed = F.transform("sources", lambda s: F.struct(F.coalesce(s["source_name"], blank).alias("name"), F.coalesce(s["url"], blank).alias("url")))
    known = lambda seen, x: F.exists(seen, lambda s: (s["url"] == x["url"]) | (s["name"] == x["name"]))
    fold = F.aggregate(listed, F.filter(F.array(own), lambda _: F.lit(False)), lambda seen, x: F.when((x["url"] == "") | known(seen, x), seen).otherwise(F.array_append(seen, x)))
    return news.withColumn("links", F.when((own["url"] != "") & ~F.exists(fold, lambda s: s["name"] == own["name"]), F.array_prepend(fold, own)).otherwise(fold))


def by_source(news: DataFrame) -> DataFrame:
    """source, n, place: news of each source, most first, of equal counts by name."""
    from pyspark.sql import Window

    counted = stats(news).where("kind = 'by_source'").select(F.col("key").alias("source"), "n")
    # One row for each source: sites are few, and the window sees only their counts.
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source")))


def keywords_flat(lexicon: DataFrame) -> DataFrame:
    """category, keywords: the distinct keywords of each category, sorted."""
    return lexicon.groupBy("category").agg(F.sort_array(F.collect_set("keyword")).alias("keywords"))


def to_json(news: DataFrame, path: str) -> None:
    """News as JSON lines without embeddings: times in UTC, missing values as nulls."""
    news.drop("embedding").write.mode("overwrite").option("ignoreNullFields", "false").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)
