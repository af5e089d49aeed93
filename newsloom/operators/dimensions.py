"""What a profile knows, as small tables for clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.profiles import Profile


def categories(spark: SparkSession, profile: Profile) -> DataFrame:
    """ord, category, display."""
    return spark.createDataFrame([(i, c, profile.display.get(c, c)) for i, c in enumerate(profile.categories)], "ord int, category string, display string")


def districts(spark: SparkSession, profile: Profile) -> DataFrame:
    """ord, district, variants."""
    return spark.createDataFrame([(i, d, list(v)) for i, (d, v) in enumerate(profile.districts)], "ord int, district string, variants array<string>")
