"""A table kept as Parquet snapshots: every write makes a new version, then moves the pointer to it.

Readers never meet a half-written table, and a writer that dies leaves the old version in place. A writer claims the
version it makes, so of two at a time one fails; one that names the version it read fails too if there is a newer one.
All file access goes through Hadoop's file systems, so a store may live wherever Spark can read.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("source_key", "source_name", "url")])
LOCATION = T.StructType([
    T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("district", T.StringType()),
    T.StructField("formatted", T.StringType()), T.StructField("geocode_fallback", T.BooleanType()),
])
NEWS = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("_id", "title", "content", "summary", "category", "category_display")], T.StructField("location", LOCATION),
    T.StructField("published_at", T.TimestampType()), T.StructField("url", T.StringType()), T.StructField("sources", T.ArrayType(SOURCE)),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])
CACHE = T.StructType([T.StructField("address", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), T.StructField("formatted", T.StringType()), T.StructField("cached_at", T.TimestampType())])


class ConcurrentWrite(RuntimeError):
    """Another writer is at work, or was since the table was read."""


class Snapshots:
    """``claim_s``: seconds after which the claim of a writer that never ended is void."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keep: int = 2, claim_s: float = 6 * 3600):
        self.spark, self.path, self.schema, self.keep, self.claim_s = spark, path.rstrip("/"), schema, keep, claim_s

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """Versions whose write is complete, ascending. The marker of Spark's committer is the pointer."""
        fs = self._fs()
        if not fs.exists(self._at("")) and not fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(self._at(f"{n}/_SUCCESS")))

    def latest(self) -> int:
        """The newest version, 0 for an empty store."""
        return (self.versions() or [0])[-1]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the newest if none is named."""
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def _claim(self, version: int):
        fs, claim = self._fs(), self._at(f"_claim-{version}")
        if fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > self.claim_s:
            fs.delete(claim, False)
        if not fs.createNewFile(claim):
            raise ConcurrentWrite(f"version {version} of {self.path} is being written")
        return claim

    def write(self, df: DataFrame, base: int | None = None) -> int:
        """A new version with these rows; older ones than the last ``keep`` are deleted.

        ``base``: the version that the rows were made from.
        """
        versions = self.versions()
        newest = versions[-1] if versions else 0
        new, claim = newest + 1, self._claim(newest + 1)
        try:
            # The version may have been made between the listing and the claim.
            if self.latest() != newest or (base is not None and base != newest):
                raise ConcurrentWrite(f"{self.path} has version {self.latest()}, not {newest if base is None else base}")
            df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/v={new}")
        finally:
            self._fs().delete(claim, False)
        for old in versions[: -(self.keep - 1) or None]:
            self._fs().delete(self._at(f"v={old}"), True)
        return new

    def clear(self, confirm: bool = False) -> int:
        """Empty the table; how many rows it had."""
        if not confirm:
            raise ValueError("clearing a table needs confirm=True")
        n = self.read().count()
        self.write(self.spark.createDataFrame([], self.schema))
        return n


def upsert(old: DataFrame, new: DataFrame, key: str = "url", id_col: str | None = "_id", order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new``, which replace rows of their key; replaced rows keep their id.

    Rows without a key are not taken. Of several new rows of a key the last by ``order`` counts.
    """
    from pyspark.sql import Window

    new = new.where(F.col(key).isNotNull() & (F.col(key) != ""))
    if order:
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        new = new.withColumn("_place", place).where("_place = 1").drop("_place", *([order] if order not in old.columns else []))
    if id_col:
        known = old.select(key, F.col(id_col).alias("_old"))
        fresh = F.coalesce("_old", F.col(id_col), F.sha2(F.col(key), 256))
        new = new.join(known, key, "left").withColumn(id_col, fresh).drop("_old")
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def add_sources(news: DataFrame, added: DataFrame) -> DataFrame:
    """``news`` with sources (_id, ord, source_key, source_name, url) appended, each address once for a row."""
    listed = added.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source_key", "source_name", "url"))).alias("_more"))
    entry = lambda x: F.struct(x["source_key"].alias("source_key"), x["source_name"].alias("source_name"), x["url"].alias("url"))
    grown = F.aggregate("_more", F.col("sources"), lambda seen, x: F.when(F.exists(seen, lambda s: s["url"] == x["url"]), seen).otherwise(F.array_append(seen, entry(x))))
    out = news.join(listed, "_id", "left").withColumn("sources", F.when(F.col("_more").isNull(), F.col("sources")).otherwise(grown))
    return out.select(*news.columns)


def purge(news: DataFrame, cutoff, ts: str = "published_at") -> DataFrame:
    """Rows at the cutoff or later, and undated ones."""
    return news.where(F.col(ts).isNull() | (F.col(ts) >= F.lit(cutoff)))
