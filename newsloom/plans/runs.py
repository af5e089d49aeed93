"""A whole run over the stores, with its progress and its counters."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from newsloom.operators import listing
from newsloom.plans.ingest import Ingest, ingest
from newsloom.sources.snapshots import Snapshots, purge
from newsloom.sources.specs import of_sources

COUNTERS = "started_at timestamp, ended_at timestamp, scraped long, saved long, duplicate long, no_category long, no_location long, geocode_failed long, errors long, geocode_fallback long, merged long"


@dataclass
class Progress:
    """What a run is doing, for a client that asks while it goes on."""

    phase: str = ""
    message: str = ""
    articles_processed: int = 0
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def set(self, phase: str | None = None, message: str | None = None, articles: int = 0) -> None:
        with self._lock:
            self.phase, self.message = phase if phase is not None else self.phase, message if message is not None else self.message
            self.articles_processed += articles

    def get(self) -> dict[str, object]:
        with self._lock:
            return {"phase": self.phase, "message": self.message, "articles_processed": self.articles_processed}


class StreamProgress(StreamingQueryListener):
    """Moves a ``Progress`` as micro-batches end."""

    def __init__(self, progress: Progress):
        self._progress = progress

    def onQueryStarted(self, event) -> None:
        self._progress.set("scraping", f"stream {event.id} began")

    def onQueryProgress(self, event) -> None:
        self._progress.set(message=f"batch {event.progress.batchId}", articles=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._progress.set("done" if event.exception is None else "error", event.exception or "stream ended")


def run_pipeline(spark: SparkSession, articles: DataFrame, news: Snapshots, cache: Snapshots, run: Ingest, sources: Sequence[str] | None = None, progress: Progress | None = None, keep_days: int | None = None) -> DataFrame:
    """Ingest the articles of these sources (all, if none are named) into the news store; one row of counters.

    With ``keep_days`` news older than that go first. Addresses that the provider resolves join the cache store. If another
    run writes the news store meanwhile, this one ends with ``sources.snapshots.ConcurrentWrite`` and changes nothing.
    """
    progress = progress or Progress()
    started = dt.datetime.now(dt.timezone.utc)
    progress.set("embedding", "reading the stores")
    base = news.latest()
    old = news.read(base)
    if keep_days is not None:
        old = purge(old, run.as_of - dt.timedelta(days=keep_days))
    progress.set("scraping", "classifying, placing and comparing articles")
    fresh_cache: list[DataFrame] = []
    merged_rows: list[DataFrame] = []
    table, outcomes = ingest(of_sources(articles, sources), old, cache.read(), run, fresh_cache.append, merged_rows.append)
    progress.set("merge", "merging news of one story")
    outcomes = outcomes.checkpoint()
    news.write(table, base)
    for rows in fresh_cache:
        cache.write(rows)
    counted = listing.run_counters(outcomes, F.col("geocode_fallback"))
    merged = sum(c.agg(F.count("*") - F.count_distinct("cluster")).first()[0] for c in merged_rows)
    row = counted.first().asDict()
    progress.set("done", "finished", row["scraped"])
    order = [c.split()[0] for c in COUNTERS.split(", ")]
    row |= {"started_at": started, "ended_at": dt.datetime.now(dt.timezone.utc), "merged": merged}
    return spark.createDataFrame([tuple(row[c] for c in order)], COUNTERS)
