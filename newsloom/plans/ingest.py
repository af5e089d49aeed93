"""The batch plan: pages or articles in, a merged news table out, every step a DataFrame -> DataFrame function."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import day_key
from newsloom.functions.text import clean, title_ok
from newsloom.operators import duplicates, embedding, geocode, graph, location, scoring, summaries
from newsloom.profiles import Profile
from newsloom.sources import snapshots


@dataclass
class Ingest:
    """What a run needs beyond its input.

    ``embed`` adds the column embedding to rows with title and content. Without one (None) a hashed projection is fitted
    to the stored and the arriving articles, and the stored ones are embedded anew, so that all vectors of a run compare;
    a fitted ``embedding.HashedEmbedding`` spares that.
    """

    profile: Profile
    lexicon: DataFrame
    embed: Callable[[DataFrame], DataFrame] | None
    as_of: dt.datetime
    gazetteer: DataFrame | None = None
    days: int = 3
    merge: bool = True
    #: Coordinates for addresses that the cache lacks: (address) -> (address, lat, lng, formatted).
    provider: Callable[[DataFrame], DataFrame] | None = None
    #: Whether rows without coordinates are placed at the profile's centre; else they end as geocode_failed.
    fallback: bool = True


def prepare(articles: DataFrame, run: Ingest) -> DataFrame:
    """Recent articles, cleaned, classified and located, with the outcome of each so far (null: goes on).

    ``articles`` has url, title, content, published_at, source_key, source_name and ord, its place in the order of
    arrival. Addresses are unique from here on: of several the first.
    """
    recent = articles.where(F.col("published_at") >= F.lit(run.as_of - dt.timedelta(days=run.days)))
    recent = duplicates.first_of(recent, ["url"], ["ord"])
    text = recent.withColumns({"title": clean(F.col("title")), "content": clean(F.col("content"))}).checkpoint()
    cats = scoring.classify(text, run.lexicon, run.profile, id_col="ord", title_col="title", body_col="content", url_col="url").select(F.col("id").alias("ord"), "category")
    text = text.join(cats, "ord", "left")
    places = location.extract_location(text, run.profile, run.gazetteer, True, "category", "ord", "title", "content", "url").withColumnRenamed("id", "ord").withColumnRenamed("geocode_fallback", "_guess")
    text = text.join(places, "ord", "left")
    outcome = F.when(~title_ok(F.col("title")), "errors").when(F.col("category").isNull(), "no_category").when(F.col("geocode_query").isNull(), "no_location")
    return text.withColumn("outcome", outcome)


def ingest(articles: DataFrame, news: DataFrame, cache: DataFrame, run: Ingest, keep_cache: Callable[[DataFrame], object] | None = None, on_merged: Callable[[DataFrame], object] | None = None) -> tuple[DataFrame, DataFrame]:
    """The new news table, and one row for each article: ord, url, outcome, geocode_fallback.

    ``keep_cache`` is given the cache with the addresses that the provider resolved, if it was asked; ``on_merged`` the
    rows of clusters (id, ord, cluster) of which all but one are deleted, if news are merged.
    """
    graph.checkpoint_folder(articles.sparkSession)
    ready = prepare(articles, run).checkpoint()
    arriving = ready.where("outcome is null")
    embed = run.embed
    if embed is None:
        texts = [x.select(F.concat_ws(" ", "title", "content").alias("t")) for x in (news, arriving)]
        embed = embedding.fit(texts[0].unionByName(texts[1]), F.col("t"))
        embed.weights = embed.weights.checkpoint()
        news = embed(news, "_id").select(*news.columns).checkpoint()
    going = embed(arriving).checkpoint()
    stored = in_order(news.withColumn("id", F.col("_id")), "published_at", "_id").select("id", "ord", "category", "embedding")
    arrivals = going.select(F.concat(F.lit("new:"), F.col("ord").cast("string")).alias("id"), F.col("ord").cast("long").alias("ord"), "category", "embedding")
    kept = duplicates.dedupe_sequence(arrivals, stored=stored).checkpoint()
    decided = going.withColumn("id", F.concat(F.lit("new:"), F.col("ord").cast("string"))).join(kept, "id").withColumn("repeats", F.col("kept") != F.col("id"))
    asked = decided.where("not repeats").withColumn("candidates", location.geocode_candidates(F.col("geocode_query"), F.col("location_text"), F.col("district"), run.profile))
    if run.provider:
        wanted = asked.select(F.explode(F.slice("candidates", 1, geocode.MOST_CANDIDATES)).alias("address"))
        cache = geocode.known_and_new(cache, geocode.resolve_missing(wanted, cache, run.provider, run.as_of)).checkpoint()
        if keep_cache:
            keep_cache(cache)
    found = geocode.geocode_chain(asked, cache)
    found = geocode.center_fallback(found, run.profile.center, run.profile.center_label, run.fallback).checkpoint()
    failed = found.where("lat is null").select("id")
    # Repeats of a row without a place go with it: nothing was stored that they could join.
    placed = asked.join(found.where("lat is not null").drop("address"), "id")
    with_sentences = placed.withColumn("listed", summaries.sentences(F.col("content")))
    similarity = None
    if isinstance(embed, embedding.HashedEmbedding):
        with_sentences = with_sentences.checkpoint()
        near = embedding.sentence_similarity(with_sentences, embed, "ord", F.col("title"), F.col("listed")).withColumnRenamed("id", "_near")
        with_sentences = with_sentences.join(near, F.col("ord").cast("string") == F.col("_near"), "left")
        similarity = F.coalesce("similarity", F.array().cast("array<double>"))
    fresh = with_sentences.select(
        F.sha2("url", 256).alias("_id"), "title", "content", summaries.summary(F.col("title"), F.col("content"), F.col("listed"), similarity).alias("summary"), "category",
        scoring.display_name(F.col("category"), run.profile).alias("category_display"),
        F.struct("lat", "lng", F.col("location_text").alias("text"), "district", "formatted", "geocode_fallback").alias("location"), "published_at", "url",
        F.array(F.struct("source_key", "source_name", "url")).alias("sources"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("ord").alias("_ord"),
    ).checkpoint()
    names = fresh.select("_id", F.concat(F.lit("new:"), F.col("_ord").cast("string")).alias("k"))
    more = decided.where("repeats").join(names, F.col("kept") == F.col("k"), "left").select(F.coalesce("_id", "kept").alias("_id"), "ord", "source_key", "source_name", "url")
    out = snapshots.add_sources(snapshots.upsert(news, fresh.drop("_ord")), more)
    if run.merge:
        ordered = in_order(out.withColumns({"id": F.col("_id"), "day": day_key(F.col("published_at"))}), "published_at", "_id")
        clusters = duplicates.merge_clusters(ordered, duplicates.merge_pairs(ordered)).checkpoint()
        if on_merged:
            on_merged(clusters)
        out = duplicates.merge_apply(ordered, clusters).select(*news.columns)
    lost = decided.join(failed.select(F.col("id").alias("kept")), "kept", "left_semi").select("ord", F.lit(True).alias("lost"))
    ended = ready.join(decided.select("ord", "repeats"), "ord", "left").join(lost, "ord", "left")
    late = F.when(F.col("lost"), "geocode_failed").when(F.col("repeats"), "duplicate").otherwise("saved")
    guessed = found.where("geocode_fallback").select(F.expr("cast(substr(id, 5) as long)").alias("ord"), F.lit(True).alias("guess"))
    ended = ended.withColumn("outcome", F.coalesce("outcome", late)).join(guessed, "ord", "left")
    return out, ended.select("ord", "url", "outcome", F.coalesce("guess", F.lit(False)).alias("geocode_fallback"))


def in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ord, ascending with the columns (nulls last); numbers have gaps. Sorted in ranges, not in one task."""
    by = [F.col(c).asc_nulls_last() for c in columns]
    graph.checkpoint_folder(rows.sparkSession)
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("ord", F.monotonically_increasing_id()).checkpoint()


def relocate(news: DataFrame, profile: Profile, gazetteer: DataFrame | None = None) -> DataFrame:
    """Places found again: _id, location_text, district and outcome deleted, updated or unchanged."""
    again = location.extract_location(news, profile, gazetteer, True, "category", "_id", "title", "content", "url")
    both = news.select("_id", F.col("location.text").alias("old_text"), F.col("location.district").alias("old_district")).join(again.withColumnRenamed("id", "_id"), "_id", "left")
    same = F.col("old_text").eqNullSafe(F.col("location_text")) & F.col("old_district").eqNullSafe(F.col("district"))
    return both.select("_id", "location_text", "district", F.when(F.col("location_text").isNull(), "deleted").when(same, "unchanged").otherwise("updated").alias("outcome"))


def resummarise(news: DataFrame) -> DataFrame:
    listed = news.withColumn("_s", summaries.sentences(F.col("content")))
    return listed.withColumn("summary", summaries.summary(F.col("title"), F.col("content"), F.col("_s"))).drop("_s")
