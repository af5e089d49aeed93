"""Coordinates of addresses through a cache table, a chain of candidates and a fallback."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import py_trim

MOST_CANDIDATES = 4


def geocode_chain(rows: DataFrame, cache: DataFrame, most: int = MOST_CANDIDATES, id_col: str = "id", candidates_col: str = "candidates") -> DataFrame:
    """id, address, lat, lng, formatted: the first of a row's candidate addresses that the cache knows (null if none).

    Candidates are trimmed; empty and repeated ones do not count; ``most`` are tried.
    """
    tried = F.slice(F.array_distinct(F.filter(F.transform(candidates_col, py_trim), lambda x: x.isNotNull() & (x != ""))), 1, most)
    asked = rows.select(F.col(id_col).alias("id"), F.posexplode_outer(tried).alias("pos", "address"))
    found = asked.join(cache.select("address", "lat", "lng", "formatted"), "address", "left")
    best = F.min_by(F.struct("address", "lat", "lng", "formatted"), F.when(F.col("lat").isNotNull(), F.col("pos")))
    return found.groupBy("id").agg(best.alias("b")).select("id", "b.address", "b.lat", "b.lng", "b.formatted")


def center_fallback(found: DataFrame, center: tuple[float, float], label: str, enabled: bool = True) -> DataFrame:
    """Rows without coordinates get the centre and geocode_fallback = true."""
    lost = F.col("lat").isNull() & F.lit(enabled)
    new = {"lat": F.when(lost, F.lit(center[0])).otherwise(F.col("lat")), "lng": F.when(lost, F.lit(center[1])).otherwise(F.col("lng")), "formatted": F.when(lost, F.lit(label)).otherwise(F.col("formatted"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in found.columns], lost.alias("geocode_fallback"))


def resolve_missing(addresses: DataFrame, cache: DataFrame, provider: Callable[[DataFrame], DataFrame], as_of: dt.datetime) -> DataFrame:
    """Cache rows for the addresses that the cache lacks, from a provider of (address, lat, lng, formatted)."""
    missing = addresses.select("address").distinct().join(cache, "address", "left_anti")
    return provider(missing).where("lat is not null").withColumn("cached_at", F.lit(as_of))


def known_and_new(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with new rows in place of old ones of their address."""
    return cache.join(fresh.select("address"), "address", "left_anti").unionByName(fresh.select(*cache.columns))
