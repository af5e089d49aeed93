"""Benchmark decontamination by word windows. Native: DataFrame functions only.

Every window of ``window`` consecutive item words (a shorter item is one window) goes into a broadcast hash table, keyed
by the hash of the whole window, so windows that begin alike don't meet each other. Each document position probes the
table inside one generated stage, once for each length that windows have (mostly one; ``window`` at most), and a
position that hits compares the window word by word. Hashes fold case by ``lower``, which no pair of words equal after
A-Z folding can tell apart; only confirmed hits fold exactly. So documents are scanned once without a shuffle. A
sentinel position for each row brings its word count along, and all that a document yields is combined before it is
shuffled. The broadcast holds at most ``broadcast_windows`` windows and mentions of items; more of them meet the
documents' positions in one shuffle on the same hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

#: What separates words, A-Z being letters too.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SENTINEL = 0x5E17A5E17A5E17A5
_UNIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """The words of a text as they stand: runs of other than ASCII separators. None for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def folded(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(w, common.ASCII_UPPER, common.ASCII_LOWER))


def _word_hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _with_hashes(df: DataFrame, words: str, lengths: list[int], out: str) -> DataFrame:
    """Add the hashes of the words from each position on, for one length after the other, each as many as there are words.

    A length that is no power of two is put together from two overlapping runs. Each step is a projection of its own, or
    its input would be computed for every time it is named. The last positions, which have fewer words, hash what there
    is and match no window.
    """
    df, level = df.withColumn("_h1", F.transform(words, _word_hash)), 1
    names = ["_h1"]
    while 2 * level <= max(lengths):
        half = F.col(f"_h{level}")
        df = df.withColumn(f"_h{2 * level}", F.zip_with(half, F.slice(half, level + 1, F.size(half)), lambda x, y: F.xxhash64(x, y)))
        level *= 2
        names.append(f"_h{level}")
    parts = []
    for n in lengths:
        run = F.col(f"_h{1 << (n.bit_length() - 1)}")
        rest = n - (1 << (n.bit_length() - 1))
        parts.append(F.zip_with(run, F.slice(run, rest + 1, F.size(run)), lambda x, y: F.xxhash64(x, y)) if rest else run)
    return df.withColumn(out, parts[0] if len(parts) == 1 else F.concat(*parts)).drop(*names)


def _shuffled_hits(base: DataFrame, wins: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits of windows too many to broadcast: one shuffle of position hashes.

    Whole windows are hashed, so a position meets one window at most (but for collisions), however many begin alike; a
    passage that many documents share makes long groups of one key on the documents' side only, which AQE splits. Hits
    are then compared word by word.
    """
    keyed = base.withColumn("key", F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("doc_id").isNull().alias("none"), F.coalesce("text_hash", F.lit(0)).alias("hash")))
    spots = _with_hashes(keyed, "ws", lengths, "hs").select("key", F.size("ws").alias("n"), F.posexplode("hs").alias("at", "h"))
    near = spots.join(wins.select("h", "win", "items"), "h").select("key", F.pmod("at", "n").alias("pos"), "win", "items")
    found = common.materialise(near, "hits")
    words = keyed.join(found.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    both = found.join(words, "key").where(F.slice(folded(F.col("ws")), F.col("pos") + 1, F.size("win")) == F.col("win"))
    return both.select("doc_id", "text_hash", F.struct("pos", (F.col("pos") + F.size("win")).alias("end")).alias("span"), "items", F.lit(None).cast("int").alias("n_words"))


def benchmark_windows(benchmark: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """h, win (array of words), items (array of ids as strings): one row per distinct window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), folded(raw_words(F.col(text_col).cast("string"))).alias("ws"))
    items = items.where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    wins = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("win"))
    wins = wins.groupBy("win").agg(F.collect_set("item").alias("items"))
    lengths = list(range(1, window + 1))
    # The hash of length n at the first word is the first of the n-th list.
    hashed = _with_hashes(wins, "win", lengths, "hs")
    return hashed.select(F.element_at("hs", (F.size("win") - 1) * F.size("win") + 1).alias("h"), "win", "items")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    broadcast_windows: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: int = 20,
    spans: bool = False,
) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``.

    A word inside any occurrence of a benchmark window is hit; a document is contaminated if ``share * n_hit >=
    n_words`` and some word is hit. Null and empty texts have no words. Ids may be null or repeat: rows are told apart
    by id and text, and equal rows get equal results. Items without words, or an empty benchmark, hit nothing; an item
    without an id hits but is not listed. Other columns are ignored. ``spans`` adds the hit ranges (start, end) of words.
    """
    spark = docs.sparkSession
    wins = common.materialise(benchmark_windows(benchmark, window), "windows")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), raw_words(F.col(text_col).cast("string")).alias("ws"))
    sizes = {r.l: r.n for r in wins.groupBy(F.size("win").alias("l")).agg(F.sum(F.size("items") + 1).alias("n")).collect()}  # at most as many as a window has words
    lengths, many = sorted(sizes, reverse=True), sum(sizes.values()) > broadcast_windows
    # The sentinel: a hash of its own that matches an empty window, once in each row.
    table = spark.range(1).select(F.lit(_SENTINEL).alias("h"), F.array().cast("array<string>").alias("win"), F.array().cast("array<string>").alias("items"))
    probes = base.withColumn("hs", F.array(F.lit(_SENTINEL)))
    if lengths and not many:
        table = wins.unionByName(table)
        probes = _with_hashes(base, "ws", lengths, "hs").withColumn("hs", F.array_append("hs", F.lit(_SENTINEL)))
    # From the generator on, no expression may leave generated code: each position would copy its document's words.
    grams = probes.select("doc_id", "text_hash", "ws", F.posexplode_outer("hs").alias("at", "h"))
    table = table.select("h", "win", "items", F.array_join("win", " ").alias("win_text"))
    pos = F.pmod(F.col("at"), F.greatest(F.size("ws"), F.lit(1)))
    here = F.array_join(F.slice("ws", pos + 1, F.size("win")), " ")
    found = grams.join(F.broadcast(table), "h").where(F.translate(here, common.ASCII_UPPER, common.ASCII_LOWER) == F.col("win_text"))
    real = F.size("win") > 0
    hits = found.select(
        "doc_id", "text_hash",
        F.when(real, F.struct(pos.alias("pos"), (pos + F.size("win")).alias("end"))).alias("span"),
        F.when(real, F.col("items")).alias("items"),
        F.when(~real, F.size("ws")).alias("n_words"),
    )
    if many:
        hits = hits.unionByName(_shuffled_hits(base, wins, lengths))
    # All that one pass finds in a document lies in one task, so it is combined before the shuffle.
    merged = hits.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.max("n_words").cast("long").alias("n_words"),
        F.count("n_words").cast("int").alias("times"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["pos"], s["upto"]), F.lit(0))).cast("long").alias("n"), F.greatest(s["upto"], x["end"]).alias("upto")),
        lambda s: s["n"],
    )
    out = merged.withColumn("n_hit", covered)
    out = out.select(
        "doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *(["spans"] if spans else []), "times",
    )
    # A row for each of the rows that are alike.
    return out.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without what is contaminated. Columns and names stay as they are.

    ``remove="documents"`` drops contaminated rows. ``remove="spans"`` keeps every row and cuts the hit words, each with
    the separators before it, out of the text.
    """
    ids, text = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = contamination(docs, benchmark, spans=True, **options)
    found = found.where("contaminated" if remove == "documents" else "n_hit > 0").select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"])
    i, h, s = (common.unique_name(docs, x) for x in ("hit_id", "hit_hash", "hit_spans"))
    found = common.materialise(found.toDF(i, h, s), "found")
    same = F.col(f"`{ids}`").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(h))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    units = F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(f"({_UNIT})"), F.lit(1))
    tail = F.regexp_extract(F.col(f"`{text}`").cast("string"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    kept = F.filter(units, lambda u, k: ~F.exists(F.col(s), lambda x: (k >= x["pos"]) & (k < x["end"])))
    cut = F.when(F.col(s).isNull(), F.col(f"`{text}`").cast("string")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return docs.join(found, same, "left").select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of ``documents`` by 13-word windows of ``benchmark``."""
    out = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.drop("text_hash")


OP9_SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, ws[i : i + 12] AS win, len(ws[i : i + 12]) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
grams AS (SELECT r, p, n, ws[p : p + n - 1] AS win FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT r, p, g.n, item_id FROM grams g JOIN wins USING (win)),
covered AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS w FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
