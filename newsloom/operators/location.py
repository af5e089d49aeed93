"""Places in texts: district scores, address patterns and the composed location."""

from __future__ import annotations

import re
import uuid
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import py_trim, tr_lower
from newsloom.operators import graph
from newsloom.profiles import Profile

#: Patterns of addresses, to be matched in Unicode without case.
_BLOCK = r"[\w\sçğıöşüÇĞİÖŞÜ\.']{1,40}?"
NEIGHBOURHOOD = rf"({_BLOCK})\s+mahallesi(?:'nde|'nden|'ne|'de|'den)?"
STREET = rf"({_BLOCK})\s+(?:sokak|sk\.|sokağı|caddesi|cad\.|cadde|bulvarı|bulvar|blv\.)\s*(?:no[:\s.]?\s*\d+)?"
LANDMARKS = [
    r"[\w\sçğıöşü]{3,40}?\s+otogarı", r"[\w\sçğıöşü]{3,40}?\s+otogar", r"[\w\sçğıöşü]{3,40}?\s+terminali?", r"[\w\sçğıöşü]{3,40}?\s+köprüsü", r"organize\s+sanayi",
    r"OSB(?:'|\s|$)", r"[\w\sçğıöşü]{2,30}?\s+sanayi\s+sitesi", r"(?:kent|şehir)\s+meydanı", r"(?:kent|sehir)\s+meydani", r"kültür\s+merkezi", r"kultur\s+merkezi",
]
_FLAGS = "(?dUiu)"
#: Letters that every match of a pattern holds, whatever the case (none of them i, whose cases differ by language).
_HELD = {NEIGHBOURHOOD: ("mahalles",), STREET: ("sokak", "sk", "soka", "cad", "bulvar", "blv")} | dict(
    zip(LANDMARKS, [("otogar",), ("otogar",), ("term",), ("köpr", "kopr"), ("organ",), ("osb",), ("sanay",), ("meydan",), ("meydan",), ("merkez",), ("merkez",)], strict=True)
)


def occurrences(text: Column, word: Column | str) -> Column:
    """How often a word occurs, not overlapping itself."""
    word = F.lit(word) if isinstance(word, str) else word
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("long")


def district_scores(docs: DataFrame, profile: Profile, gazetteer: DataFrame | None = None, id_col: str = "doc_id", title_col: str = "title", body_col: str = "body", url_col: str | None = None) -> DataFrame:
    """id, district, ord, score for districts with a score above 0.

    A variant in the title gives 100, each occurrence 1, with a locative ending 35 (40 more in the title); a place of the
    gazetteer (name, district) 80 in the title, else 30; a hint in the address of the page 20. Districts are few and
    become columns; gazetteer names, which may be many, are found in one pass.
    """
    text = docs.select(
        F.col(id_col).alias("id"),
        tr_lower(F.col(title_col)).alias("tl"),
        tr_lower(py_trim(F.concat_ws(" ", F.coalesce(F.col(title_col), F.lit("")), F.coalesce(F.col(body_col), F.lit(""))))).alias("fl"),
        (tr_lower(F.col(url_col)) if url_col else F.lit("")).alias("ul"),
    )
    if gazetteer is not None:
        text = with_names(text, gazetteer, {"in_title": F.col("tl"), "in_text": F.col("fl")})
    found = []
    for i, (district, variants) in enumerate(profile.districts):
        parts = []
        for v in variants:
            # The name comes first and what may not precede it after it, or every letter would be looked back from.
            locative = rf"(?dU){re.escape(v)}(?<![{profile.letters}]{re.escape(v)}){profile.suffixes}"
            named = lambda c: F.contains(c, F.lit(v)) & F.col(c).rlike(locative)  # noqa: B023, E731
            parts += [F.when(F.contains("tl", F.lit(v)), 100).otherwise(0), occurrences(F.col("fl"), v), F.when(named("fl"), 35).otherwise(0), F.when(named("tl"), 40).otherwise(0)]
        parts += [F.when(F.contains("ul", F.lit(h)), 20).otherwise(0) for h, d in profile.url_hints if d == district]
        if gazetteer is not None:
            parts += [80 * F.size(F.filter("in_title", _of(district))), 30 * F.size(F.filter("in_text", lambda x: _of(district)(x) & ~F.array_contains("in_title", x)))]
        score = reduce(lambda a, b: a + b, parts, F.lit(0)).cast("long")
        found.append(F.struct(F.lit(district).alias("district"), F.lit(i).alias("ord"), score.alias("score")))
    return text.select("id", F.explode(F.array(*found)).alias("d")).select("id", "d.*").where("score > 0")


#: Names in one automaton, and their letters: what a worker holds at a time.
BROADCAST_NAMES, BROADCAST_LETTERS = 200_000, 8_000_000
_automata: dict[str, tuple[ahocorasick.Automaton, np.ndarray, pa.StructArray]] = {}


def _finder(names: Broadcast):
    """A column function: for each text the names within it, each with its districts. A worker builds an automaton once."""
    key = uuid.uuid4().hex

    @F.arrow_udf("array<struct<name:string,district:string>>")
    def find(texts: pa.Array) -> pa.Array:
        if key not in _automata:
            listed = sorted(names.value)
            automaton = ahocorasick.Automaton()
            for i, (name, _) in enumerate(listed):
                automaton.add_word(name, i)
            automaton.make_automaton()
            rows = [pa.array([n for n, ds in listed for _ in ds], pa.string()), pa.array([d for _, ds in listed for d in ds], pa.string())]
            _automata.clear()
            _automata[key] = automaton, np.cumsum([0] + [len(ds) for _, ds in listed]), pa.StructArray.from_arrays(rows, ["name", "district"])
        automaton, begins, rows = _automata[key]
        found, sizes = [np.empty(0, np.int64)], np.zeros(len(texts) + 1, np.int32)
        for i, x in enumerate(texts):
            x = x.as_py()
            at = np.array(sorted({hit for _, hit in automaton.iter(x)}) if x else [], np.int64)
            many = begins[at + 1] - begins[at]  # districts of each name
            found.append((np.repeat(begins[at] - np.cumsum(many) + many, many) + np.arange(many.sum())).astype(np.int32))
            sizes[i + 1] = many.sum()
        # Numbers of rows until the end: as objects the finds of a batch took gigabytes.
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), rows.take(pa.array(np.concatenate(found))))

    return find


def with_names(texts: DataFrame, gazetteer: DataFrame, within: dict[str, Column]) -> DataFrame:
    """``texts`` with, for each item of ``within``, the gazetteer's rows (name, district) whose lower-cased name it holds.

    Rows keep the order of name and district, repeats included; null texts hold nothing, and rows of the gazetteer
    without a name or district are left out. One pass of an automaton finds all names, so the time grows with the text
    and with what is found, not with the gazetteer. An automaton has at most ``BROADCAST_NAMES`` names and about
    ``BROADCAST_LETTERS`` letters, which are counted first; a longer gazetteer is dealt into shards, and the texts pass
    one shard at a time, with a checkpoint after each.
    """
    names = gazetteer.select(tr_lower(F.col("name")).alias("name"), "district").where("name <> '' and district is not null")
    names = names.groupBy("name").agg(F.sort_array(F.collect_list("district")).alias("districts"))
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("letters")).first()
    shards = max(1, -(-size.n // BROADCAST_NAMES), -(-size.letters // BROADCAST_LETTERS))
    context = texts.sparkSession.sparkContext
    texts = texts.withColumns(within)
    looked = {out: f"_in_{out}" for out in within}
    texts = texts.withColumnsRenamed(looked).withColumns({out: F.array().cast("array<struct<name:string,district:string>>") for out in within})
    for i in range(shards):
        part = context.broadcast([(r.name, r.districts) for r in names.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == i).collect()])  # a shard of a known size
        find = _finder(part)
        texts = texts.withColumns({out: F.concat(out, find(looked[out])) for out in within} if part.value else {})
        if shards > 1:
            graph.checkpoint_folder(texts.sparkSession)
            texts = texts.checkpoint()
            part.unpersist()
    order = {out: F.array_sort(out) for out in within} if shards > 1 else {}
    return texts.withColumns(order).drop(*looked.values())


def _of(district: str):
    return lambda x: x["district"] == district


def best_district(scores: DataFrame) -> DataFrame:
    """id, district, score: the largest score, of equals the first district."""
    return scores.groupBy("id").agg(F.max_by(F.struct("district", "score"), F.struct("score", -F.col("ord"))).alias("b")).select("id", "b.*")


def foreign_text(title: Column, full: Column, profile: Profile) -> Column:
    """Whether a text doesn't name the province, and a foreign city in its title, or twice."""
    cities = [F.contains(title, F.lit(c)) | (occurrences(full, c) >= 2) for c in profile.foreign]
    hit = reduce(lambda a, b: a | b, cities, F.lit(False))
    province = tr_lower(F.lit(profile.province))
    return ~F.contains(full, province) & hit


def foreign_veto(title: Column, full: Column, district: Column, profile: Profile) -> Column:
    """Whether a text without district or province names a foreign city in its title, or twice."""
    return district.isNull() & foreign_text(title, full, profile)


def extract_location(docs: DataFrame, profile: Profile, gazetteer: DataFrame | None = None, assume_local: bool = True, category_col: str | None = None, id_col: str = "doc_id", title_col: str = "title", body_col: str = "body", url_col: str | None = None) -> DataFrame:
    """id, location_text, district, address, geocode_query, geocode_fallback: one row per document (ids are unique).

    Address patterns give an address; it, the district and the province compose the text. Without either, a text that
    names the province or, if ``assume_local``, a local hint or any category is placed in the province (fallback).
    """
    best = best_district(district_scores(docs, profile, gazetteer, id_col, title_col, body_col, url_col)).drop("score")
    raw = py_trim(F.concat_ws(" ", F.coalesce(F.col(title_col), F.lit("")), F.coalesce(F.col(body_col), F.lit(""))))
    category = F.col(category_col) if category_col else F.lit(None).cast("string")
    out = docs.select(F.col(id_col).alias("id"), raw.alias("raw"), tr_lower(F.col(title_col)).alias("tl"), category.alias("category")).join(best, "id", "left")
    out = out.withColumn("fl", tr_lower(F.col("raw")))
    out = out.withColumn("veto", foreign_veto(F.col("tl"), F.col("fl"), F.col("district"), profile))

    def matched(pattern: str) -> Column:
        """A pattern that begins with an open block costs 40 steps a character: look for its letters, then its fixed end."""
        end = re.split(r"\\s\+", pattern, maxsplit=1)[-1]
        held = reduce(lambda a, b: a | b, [F.contains("low", F.lit(x)) for x in _HELD[pattern]])
        return F.when(held & F.col("raw").rlike(_FLAGS + end), F.regexp_extract("raw", _FLAGS + pattern, 0)).otherwise("")

    out = out.withColumn("low", F.lower("raw")).withColumns({"mah": matched(NEIGHBOURHOOD), "street": py_trim(matched(STREET))})
    out = out.withColumns({"block": py_trim(F.regexp_extract("mah", _FLAGS + NEIGHBOURHOOD, 1)), "mah": py_trim(F.col("mah"))})
    if gazetteer is not None:
        out = with_names(out, gazetteer, {"within": tr_lower(F.col("block"))})
        inside = F.get("within", F.lit(0))
        out = out.withColumn("district", F.coalesce("district", F.when(F.col("block") != "", inside["district"])))
    first = F.when(F.col("mah") == "", None).when(F.length("block") >= 2, F.concat("block", F.lit(" Mahallesi"))).otherwise(F.col("mah"))
    out = out.withColumn("first", first)
    street = F.when((F.col("street") != "") & ~F.contains(F.coalesce("first", F.lit("")), F.col("street")), F.col("street"))
    landmark = F.coalesce(*[F.nullif(py_trim(matched(p)), F.lit("")) for p in LANDMARKS])
    parts = F.nullif(F.concat_ws(", ", "first", street), F.lit(""))
    out = out.withColumn("address", F.coalesce(parts, landmark))
    local = F.contains("fl", tr_lower(F.lit(profile.province)))
    if assume_local:
        hints = reduce(lambda a, b: a | b, [F.contains("fl", F.lit(h)) for h in profile.local_hints], F.lit(False))
        local = local | hints | F.col("category").isin(*profile.categories)
    composed = F.concat_ws(", ", "address", "district", F.lit(profile.province))
    placed = F.when(F.col("address").isNotNull() | F.col("district").isNotNull(), composed).when(F.coalesce(local, F.lit(False)), F.lit(profile.province))
    out = out.withColumn("location_text", F.when(~F.col("veto"), placed))
    kept = F.col("location_text").isNotNull()
    return out.select(
        "id", "location_text", F.when(kept, F.col("district")).alias("district"), F.when(kept, F.col("address")).alias("address"),
        F.when(kept, F.concat("location_text", F.lit(", " + profile.country))).alias("geocode_query"),
        (kept & F.col("address").isNull() & F.col("district").isNull()).alias("geocode_fallback"),
    )


def geocode_candidates(query: Column, text: Column, district: Column, profile: Profile) -> Column:
    """The addresses to try, in order, without empty and repeated ones."""
    tail = F.lit(f", {profile.country}")
    other = F.when(text != F.coalesce(query, F.lit("")), text)
    listed = F.array(query, F.concat(other, tail), other, F.concat(district, F.lit(f", {profile.province}"), tail), *map(F.lit, profile.default_addresses))
    return F.array_distinct(F.filter(F.transform(listed, py_trim), lambda x: x.isNotNull() & (x != "")))
