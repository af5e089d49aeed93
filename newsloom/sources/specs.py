"""News sites as a dimension: where their listings are and what their article addresses look like."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources import pages


@dataclass(frozen=True)
class Source:
    """A site. ``paths`` of listings follow its address; ``pattern`` is found in article addresses."""

    key: str
    name: str
    base: str
    pattern: str
    paths: tuple[str, ...] = ()


#: Fixed values of the Turkish profile.
TURKISH_SOURCES = (
    Source(
        "cagdaskocaeli", "Çağdaş Kocaeli", "https://www.cagdaskocaeli.com.tr", r"/haber/\d+/[^\s]+",
        (
            "kocaeli-trafik-haberleri", "kocaeli-yangin-haberleri", "kocaeli-asayis-haberleri", "kocaeli-gundem-haberleri",
            "kocaeli-ekonomi-haberleri", "kocaeli-siyaset-haberleri", "kocaeli-yasam-haberleri", "kocaeli-spor-haberleri", "kocaeli-egitim-haberleri",
            "kocaeli-son-dakika-haberleri", "kocaeli-kultur-sanat-haberleri",
        ),
    ),
    Source(
        "ozgurkocaeli", "Özgür Kocaeli", "https://www.ozgurkocaeli.com.tr", r"/haber/\d+/[^\s]+",
        (
            "kocaeli-trafik-haberleri", "kocaeli-yangin-haberleri", "kocaeli-yasam-haberleri", "kocaeli-gundem-haberleri", "kocaeli-asayis-haberleri",
            "kocaeli-spor-haberleri", "kocaeli-ekonomi-haberleri", "kocaeli-siyaset-haberleri", "kocaeli-egitim-haberleri",
            "kocaeli-kultur-sanat-haberleri",
        ),
    ),
    Source(
        "seskocaeli", "Ses Kocaeli", "https://www.seskocaeli.com", r"/haber/\d+/[^\s]+|/[a-z-]+-\d+\.html",
        (
            "kocaeli-trafik-haberleri", "kocaeli-yangin-haberleri", "kocaeli-asayis-haberleri", "kocaeli-son-dakika-haberleri",
            "kocaeli-gundem-haberleri", "kocaeli-yasam-haberleri", "kocaeli-spor-haberleri", "kocaeli-ekonomi-haberleri", "kocaeli-egitim-haberleri",
            "kocaeli-kultur-sanat-haberleri",
        ),
    ),
    Source(
        "yenikocaeli", "Yeni Kocaeli", "https://www.yenikocaeli.com", r"/haber/[^/]+/[^/]+/\d+\.html",
        (
            "haber/guncel", "haber/kocaeli", "haber/yasam.html", "haber/kultur.html", "haber/egitim.html", "haber/spor.html", "haber/asayis.html",
            "haber/trafik.html", "haber/yangin.html", "haber/enerji.html", "haber/ekonomi.html", "haber/siyaset.html", "haber/magazin.html",
        ),
    ),
    Source(
        "bizimyaka", "Bizim Yaka", "https://www.bizimyaka.com", r"/haber/\d+/[^\s]+",
        (
            "kocaeli-trafik-haberleri", "kocaeli-yangin-haberleri", "kocaeli-asayis-haberleri", "kocaeli-egitim-haberleri", "kocaeli-spor-haberleri",
            "kocaeli-ekonomi-haberleri", "kocaeli-siyaset-haberleri", "kocaeli-son-dakika-haberleri", "kocaeli-yasam-haberleri",
            "kocaeli-gundem-haberleri", "kocaeli-kultur-sanat-haberleri",
        ),
    ),
)


def chosen(sources: Sequence[Source], keys: Sequence[str] | None = None) -> list[Source]:
    """The sources of these keys in their own order; all, if no keys are given. Unknown keys are an error."""
    if not keys:
        return list(sources)
    if missing := set(keys) - {s.key for s in sources}:
        raise ValueError(f"unknown sources: {sorted(missing)}")
    return [s for s in sources if s.key in keys]


def source_table(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    return spark.createDataFrame([(s.key, s.name, s.base, s.pattern) for s in sources], "source_key string, source_name string, base string, pattern string")


def listing_urls(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """source_key, url, ord: the front page of each source, then its listings in order."""
    rows = [(s.key, "/".join([s.base.rstrip("/"), *([p] if p else [])]), i) for s in sources for i, p in enumerate(("", *s.paths))]
    return spark.createDataFrame(rows, "source_key string, url string, ord int")


def of_sources(rows: DataFrame, keys: Sequence[str] | None, key_col: str = "source_key") -> DataFrame:
    """The rows of these sources; all, if no keys are given."""
    return rows.where(F.col(key_col).isin(*keys)) if keys else rows


def collect_articles(fetched: DataFrame, sources: Sequence[Source], **limits) -> DataFrame:
    """source, url, ord: article addresses on fetched listing pages (source_key, ord, html), by each source's own pattern."""
    spark = fetched.sparkSession
    own = fetched.join(F.broadcast(source_table(spark, sources)), "source_key")
    return pages.collect_links(own, "", "base", order_col="ord", source_col="source_key", pattern_col="pattern", **limits)
