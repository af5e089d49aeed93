"""The ingest plan as a stream: each micro-batch is one run against the latest snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.plans.ingest import Ingest, ingest
from newsloom.sources.snapshots import Snapshots


def ingest_stream(articles: DataFrame, news: Snapshots, cache: Snapshots, run: Callable[[int], Ingest], checkpoint: str, watch: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Start the stream. ``run`` gives the settings of a batch by its number; ``watch`` sees outcomes as they are made.

    A batch that is run again after its snapshot was written meets its own rows there: it ends as repeats of them and the
    table stays as it is. If another writer is at work on the store, the batch fails and the stream with it.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        base = news.latest()
        table, outcomes = ingest(rows, news.read(base), cache.read(), run(number), cache.write)
        news.write(table, base)
        if watch:
            watch(number, outcomes)

    return articles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, late: str = "3 days", window: str = "1 day", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Events of each key and window, dropping those later than ``late``; the same on a stream and on a table."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "3 days", ts: str = "ts") -> DataFrame:
    """The first row of each key within the watermark; state older than it is dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
