import dataclasses
import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from newsloom.plans import runs
from newsloom.plans.ingest import Ingest, ingest, relocate, resummarise
from newsloom.profiles import TURKISH
from newsloom.sources import snapshots
from newsloom.streaming import micro_batch

NOW = dt.datetime(2025, 3, 10)
SCHEMA = "ord long, url string, title string, content string, published_at timestamp, source_key string, source_name string"


def rows():
    day = dt.datetime(2025, 3, 9)
    long = "Gebze ilçesinde meydana gelen kaza sonrası ekipler olay yerine geldi ve kaza yeri kapatıldı. "
    return [
        (1, "u1", "Gebze kaza haberi", long + "v1", day, "k1", "n1"), (2, "u2", "Gebze kaza haberi iki", long + "v1", day, "k2", "n2"), (3, "u3", "abc", long + "v2", day, "k1", "n1"),
        (4, "u4", "Kategori yok burada", "hiçbir şey yok", day, "k1", "n1"), (5, "u5", "Eski kaza haberi", long, dt.datetime(2025, 3, 1), "k1", "n1"), (6, "u6", "Darıca kaza haberi", long + "v3", day, "k1", "n1"),
    ]


def settings(spark):
    lexicon = spark.createDataFrame([("Trafik Kazasi", "kaza", 8)], "category string, keyword string, weight int")
    angle = F.when(F.endswith("content", F.lit("v1")), 0.0).otherwise(1.5)
    return Ingest(TURKISH, lexicon, lambda df: df.withColumn("embedding", F.array(F.cos(angle), F.sin(angle))), NOW, merge=False)


def test_ingest(spark):
    cache = spark.createDataFrame([("Gebze, Kocaeli, Türkiye", 1.0, 2.0, "Gebze", NOW)], snapshots.CACHE)
    news = spark.createDataFrame([], snapshots.NEWS)
    table, outcomes = ingest(spark.createDataFrame(rows(), SCHEMA), news, cache, settings(spark))
    assert {r.url: r.outcome for r in outcomes.collect()} == {"u1": "saved", "u2": "duplicate", "u3": "errors", "u4": "no_category", "u6": "saved"}
    got = {r.url: r for r in table.collect()}
    assert sorted(got) == ["u1", "u6"] and [s.url for s in got["u1"].sources] == ["u1", "u2"]
    assert got["u1"].location.lat == 1.0 and got["u1"].category_display == "Trafik Kazası" and got["u1"].summary
    assert {r.outcome for r in relocate(table, TURKISH).collect()} == {"unchanged"} and resummarise(table).count() == 2


def test_places_of_a_provider_and_rows_without_a_place(spark):
    asked = []

    def provider(addresses):
        asked.append(sorted(r.address for r in addresses.collect()))
        return addresses.select("address", F.when(F.col("address").startswith("Gebze"), 5.0).alias("lat"), F.lit(6.0).alias("lng"), F.upper("address").alias("formatted"))

    run = dataclasses.replace(settings(spark), provider=provider, fallback=False)
    empty = spark.createDataFrame([], snapshots.CACHE)
    table, outcomes = ingest(spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([], snapshots.NEWS), empty, run)
    assert {r.url: r.outcome for r in outcomes.collect()} == {"u1": "saved", "u2": "duplicate", "u3": "errors", "u4": "no_category", "u6": "geocode_failed"}
    assert {r.location.lat for r in table.collect()} == {5.0} and any(x.startswith("Gebze") for x in asked[0])
    run = dataclasses.replace(settings(spark), fallback=False)
    table, outcomes = ingest(spark.createDataFrame(rows(), SCHEMA), table.where("false"), empty, run)
    assert {r.url: r.outcome for r in outcomes.collect()}["u1"] == "geocode_failed" and table.count() == 0
    table, outcomes = ingest(spark.createDataFrame(rows(), SCHEMA), table, empty, settings(spark))
    got = {r.url: r for r in outcomes.collect()}
    assert got["u1"].outcome == "saved" and got["u1"].geocode_fallback and not got["u3"].geocode_fallback
    # The same articles again: each finds the stored row that it repeats.
    again, outcomes = ingest(spark.createDataFrame([(*r[:1], r[1] + "b", *r[2:]) for r in rows()], SCHEMA), table, empty, settings(spark))
    assert {r.outcome for r in outcomes.collect() if r.url in ("u1b", "u2b", "u6b")} == {"duplicate"} and again.count() == table.count()


@pytest.mark.filterwarnings("ignore")
def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    news, cache = snapshots.Snapshots(spark, f"file://{tmp_path}/news", snapshots.NEWS), snapshots.Snapshots(spark, f"file://{tmp_path}/cache", snapshots.CACHE)
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    query = micro_batch.ingest_stream(stream, news, cache, lambda _: settings(spark), f"file://{tmp_path}/ck")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.url for r in news.read().collect()) == ["u1", "u6"]


def test_windowed_counts(spark):
    events = spark.createDataFrame([(dt.datetime(2025, 1, 1, 5), "a"), (dt.datetime(2025, 1, 1, 6), "a"), (dt.datetime(2025, 1, 2), "b")], "ts timestamp, event_type string")
    assert sorted((r.start.day, r.event_type, r.n) for r in micro_batch.windowed_counts(events).collect()) == [(1, "a", 2), (2, "b", 1)]


def test_run_of_chosen_sources(spark, tmp_path):
    def provider(addresses):
        return addresses.select("address", F.lit(5.0).alias("lat"), F.lit(6.0).alias("lng"), F.upper("address").alias("formatted"))

    news, cache = snapshots.Snapshots(spark, f"file://{tmp_path}/news", snapshots.NEWS), snapshots.Snapshots(spark, f"file://{tmp_path}/cache", snapshots.CACHE)
    run, progress = dataclasses.replace(settings(spark), provider=provider, merge=True), runs.Progress()
    row = runs.run_pipeline(spark, spark.createDataFrame(rows(), SCHEMA), news, cache, run, ["k1"], progress, keep_days=3).first()
    assert (row.scraped, row.saved, row.duplicate, row.errors, row.no_category) == (4, 2, 0, 1, 1) and progress.get()["phase"] == "done"
    assert news.read().count() + row.merged == 2 and cache.read().count() > 0
    row = runs.run_pipeline(spark, spark.createDataFrame(rows(), SCHEMA), news, cache, run, ["k2"]).first()
    assert (row.scraped, row.duplicate) == (1, 1)


def test_first_seen_and_progress_on_a_stream(spark, tmp_path):
    day = dt.datetime(2025, 1, 1)
    spark.createDataFrame([("a", day), ("a", day), ("b", day)], "url string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    progress = runs.Progress()
    listener = runs.StreamProgress(progress)
    spark.streams.addListener(listener)
    stream = micro_batch.first_seen(spark.readStream.schema("url string, ts timestamp").parquet(f"{tmp_path}/in"), ["url"])
    query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    for _ in range(100):
        if progress.get()["phase"] == "done":
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sorted(r.url for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "b"]
    assert progress.get()["phase"] == "done" and progress.get()["articles_processed"] == 3


def test_merges_are_counted_where_they_happen(spark, tmp_path):
    news, cache = snapshots.Snapshots(spark, f"file://{tmp_path}/news", snapshots.NEWS), snapshots.Snapshots(spark, f"file://{tmp_path}/cache", snapshots.CACHE)
    run = dataclasses.replace(settings(spark), merge=True)
    first = [r for r in rows() if r[1] == "u1"]
    assert runs.run_pipeline(spark, spark.createDataFrame(first, SCHEMA), news, cache, run).first().merged == 0
    # The same address with another text takes the old row's place: nothing is merged.
    changed = [(*first[0][:3], first[0][3].replace("v1", "v2"), *first[0][4:])]
    row = runs.run_pipeline(spark, spark.createDataFrame(changed, SCHEMA), news, cache, run).first()
    assert (row.saved, row.merged, news.read().count()) == (1, 0, 1)
    # Two stories of a day whose vectors are as near as a merge asks, but not as near as a repeat.
    angle = F.when(F.endswith("content", F.lit("v1")), 0.0).otherwise(0.66)
    run = dataclasses.replace(run, embed=lambda df: df.withColumn("embedding", F.array(F.cos(angle), F.sin(angle))))
    news.clear(confirm=True)
    both = [first[0], (9, "u9", *first[0][2:3], first[0][3].replace("v1", "v2"), *first[0][4:])]
    row = runs.run_pipeline(spark, spark.createDataFrame(both, SCHEMA), news, cache, run).first()
    assert (row.saved, row.merged, news.read().count()) == (2, 1, 1)


def test_a_second_writer_is_refused(spark, tmp_path):
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/s", snapshots.CACHE)
    table = spark.createDataFrame([("a", 1.0, 2.0, "A", NOW)], snapshots.CACHE)
    assert (store.latest(), store.read().count(), store.write(table), store.latest()) == (0, 0, 1, 1)
    claim = store._claim(2)
    with pytest.raises(snapshots.ConcurrentWrite):
        store.write(table)
    assert store.read().count() == 1
    # A claim that was never given up is void after a while.
    assert snapshots.Snapshots(spark, store.path, snapshots.CACHE, claim_s=-1).write(table, base=1) == 2
    with pytest.raises(snapshots.ConcurrentWrite):
        store.write(table, base=1)
    assert store.write(table.union(table), base=2) == 3 and store.read().count() == 2 and store.read(2).count() == 1
    store._fs().delete(claim, False)


def test_a_failed_write_gives_its_claim_up(spark, tmp_path):
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/s", snapshots.CACHE)
    broken = spark.createDataFrame([("a",)], "address string").selectExpr("address", "cast(raise_error('x') as double) lat", "0d lng", "'' formatted", "timestamp'2025-01-01' cached_at")
    with pytest.raises(Exception, match="x"):
        store.write(broken)
    assert store.latest() == 0 and store.write(store.read()) == 1
