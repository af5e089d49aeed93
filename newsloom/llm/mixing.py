"""Mixing sources to target weights by Pareto order sampling. Native: DataFrame functions only.

Sizes are words. Source targets share the corpus by weight, no source above ``most`` times its own size (the excess is
reshared by weight: one sorted pass finds the level). A source's rate is target / size, and a document's expected
number of copies is its source's rate (times its own weight, if a weight column is given). The whole part of that
number is taken for certain; the fractional part p is the inclusion probability of one more copy. Documents are
ranked by Pareto's quantity (Rosen 1997)  Q = [U / (1 - U)] / [p / (1 - p)]  with U fixed by a digest of id and text,
and the lowest ranks are taken until the source's remaining words are used up: a sample of fixed size in words.

No source is sorted in one task. The cut is found by two levels of 4096 bins of Q / (1 + Q), summed before the
shuffle; only the documents of one second-level bin are ordered. What is left at the cut is filled by all later
documents, in rank order, that still fit: in rounds, each of which finds by bins how many of those no longer than the
room left fit together, orders the next ``fill`` of them, and leaves fewer candidates, until none fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import common

#: Above so many sources the per-source tables are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 100_000
_BINS = 4096


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(skey, source, source_size) -> the same with target.

    Sources by code point, null last, weigh ``weights`` in turn. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # With sources in order of cap / w, the first k of them capped, the others share at (total - caps) / weights.
    level = weighed.withColumn("cap", most * F.col("source_size"))
    level = level.withColumns({"total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every), "caps": F.sum("cap").over(upto) - F.col("cap"), "ws": F.sum("w").over(upto) - F.col("w")})
    level = level.withColumn("share", (F.col("total") - F.col("caps")) / (F.col("all_w") - F.col("ws")))
    fits = F.when(F.col("share") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("ratio"), "skey", "share"))
    level = level.withColumn("level", F.min(fits).over(every)["share"])  # of the first source in that order that is not capped
    return level.select("skey", "source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def decisions(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    fill: int = 64,
    weight_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, digest, source, size, source_size, target, copies: one row per row of ``docs``.

    Null and empty texts have size 0 and no copies. A null source is a source of its own, after all others. Rows equal
    in id and text rank together and get the same copies. Ids may be null or repeat. A source of size 0 has target 0.
    With ``weight_col`` (null: 1, negative: 0) expected copies are proportional to it within a source. Other columns
    are ignored. An empty table gives none.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)), F.lit(0.0))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))).alias("digest"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("skey"),
        common.word_count(text).alias("size"),
        weight.alias("weight"),
    )
    narrow = common.materialise(narrow, "mix")
    sums = narrow.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("heavy"))
    sums = common.materialise(sums, "mix-sources")
    targets = source_targets(sums.select("skey", "source", "source_size"), weights, most).drop("source").join(sums.select("skey", "heavy"), "skey")
    targets = _bounded(common.materialise(targets, "mix-targets"), BROADCAST_SOURCES)
    u = (F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    expected = F.when(F.col("heavy") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("heavy") * F.col("weight"))).otherwise(0.0)
    ranked = narrow.join(targets, "skey").withColumn("expected", F.when(F.col("size") > 0, expected).otherwise(0.0))
    ranked = ranked.withColumns({"certain": F.floor("expected"), "p": F.col("expected") - F.floor("expected"), "u": u})
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = ranked.withColumn("v", F.when(F.col("p") > 0, odds / (1 + odds))).drop("weight", "heavy", "expected", "p", "u")
    ranked = common.materialise(ranked, "mix-ranked")
    cell = F.least(F.floor(F.col("v") * float(_BINS * _BINS)), F.lit(_BINS * _BINS - 1))
    binned = ranked.where("v is not null").select("skey", "digest", "size", "v", F.floor(cell / _BINS).alias("b1"), (cell % _BINS).alias("b2"))
    room = ranked.groupBy("skey", "target").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    room = room.select("skey", (F.col("target") - F.col("sure")).alias("room"))

    def crossing(sums: DataFrame, room: DataFrame, bin_col: str, out: str) -> DataFrame:
        """The bin of each source in which the running sum passes its room, and the room left in that bin."""
        run = Window.partitionBy("skey").orderBy(bin_col)
        found = sums.withColumn("upto", F.sum("words").over(run)).join(room, "skey").where("upto > room")
        found = found.groupBy("skey").agg(F.min(F.struct(bin_col, (F.col("room") - F.col("upto") + F.col("words")).alias("left"))).alias("x"))
        return found.select("skey", F.col(f"x.{bin_col}").alias(out), F.col("x.left").alias("room"))

    def cuts(binned: DataFrame, room: DataFrame) -> DataFrame:
        """skey, cut, room: documents before v = cut fit together, those at it do not. Sources that fit whole are not listed."""
        first = crossing(binned.groupBy("skey", "b1").agg(F.sum("size").alias("words")), room, "b1", "c1")
        first = _bounded(common.materialise(first, "mix-cut"), BROADCAST_SOURCES)
        inside = binned.join(first.select("skey", "c1"), "skey").where("b1 = c1")
        second = crossing(inside.groupBy("skey", "b2").agg(F.sum("size").alias("words")), first.select("skey", "room"), "b2", "c2")
        second = _bounded(common.materialise(second, "mix-cut"), BROADCAST_SOURCES)
        last = inside.join(second.select("skey", "c2"), "skey").where("b2 = c2").groupBy("skey", "v").agg(F.sum("size").alias("words"))
        last = crossing(last, second.select("skey", "room"), "v", "cut")
        return _bounded(common.materialise(last, "mix-cut"), BROADCAST_SOURCES)

    last = cuts(binned, room)
    # Documents from the cut on that still fit; rows equal in id and text are one of their words together.
    after = binned.join(last, "skey").where("v >= cut and size <= room")
    after = after.groupBy("skey", "digest", "v", "b1", "b2", "room").agg(F.sum("size").alias("size")).where("size <= room")
    after = common.materialise(after, "mix-after")
    extra = None
    while not after.isEmpty():
        rooms = after.groupBy("skey").agg(F.first("room").alias("room"))
        cut = cuts(after.drop("room"), rooms)
        whole = after.drop("room").join(cut.select("skey", "cut"), "skey", "left").where("cut is null or v < cut").select("skey", "digest")
        place = F.row_number().over(Window.partitionBy("skey").orderBy("v", "digest"))
        offered = after.drop("room").join(cut, "skey").where("v >= cut and size <= room").withColumn("place", place).where(F.col("place") <= fill)
        offered = offered.groupBy("skey").agg(F.sort_array(F.collect_list(F.struct("v", "digest", "size"))).alias("offer"), F.first("room").alias("room"))
        state = F.struct(F.col("room").cast("double").alias("left"), F.array().cast("array<string>").alias("taken"))
        step = lambda s, x: F.when(x["size"] <= s["left"], F.struct((s["left"] - x["size"]).alias("left"), F.concat(s["taken"], F.array(x["digest"])).alias("taken"))).otherwise(s)
        end = F.element_at("offer", -1)
        offered = offered.select("skey", F.aggregate("offer", state, step).alias("s"), end["v"].alias("end_v"), end["digest"].alias("end_digest"))
        offered = _bounded(common.materialise(offered.select("skey", "s.left", "s.taken", "end_v", "end_digest"), "mix-fill"), BROADCAST_SOURCES)
        taken = common.materialise(whole.unionByName(offered.select("skey", F.explode("taken").alias("digest"))), "mix-taken")
        extra = taken if extra is None else extra.unionByName(taken)
        rest = after.drop("room").join(offered.select("skey", F.col("left").alias("room"), "end_v", "end_digest"), "skey")
        rest = rest.where("(v > end_v or v = end_v and digest > end_digest) and size <= room").drop("end_v", "end_digest")
        rest = common.materialise(rest, "mix-after")
        common.release(after)
        after = rest
    out = ranked.join(last.select("skey", "cut"), "skey", "left")
    if extra is None:
        out = out.withColumn("extra", F.lit(False))
    else:
        out = out.join(_bounded(extra.withColumn("extra", F.lit(True)), BROADCAST_SOURCES), ["skey", "digest"], "left")
    one_more = F.col("v").isNotNull() & (F.col("cut").isNull() | (F.col("v") < F.col("cut")) | F.coalesce("extra", F.lit(False)))
    copies = (F.col("certain") + F.when(F.coalesce(one_more, F.lit(False)), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "digest", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` itself, each row as often as the mix takes it. Columns and names stay as they are."""
    keys = {k: options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"))}
    mark, many = common.unique_name(docs, "mix_digest"), common.unique_name(docs, "mix_copies")
    taken = decisions(docs, **options).where("copies > 0").groupBy("digest", "source").agg(F.max("copies").alias(many))
    source = common.unique_name(docs, "mix_source")
    taken = taken.select(F.col("digest").alias(mark), F.col("source").alias(source), many)
    digest = F.md5(F.concat(F.coalesce(F.col(keys["id_col"]).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(keys["text_col"]).cast("string"), F.lit(""))))
    marked = docs.withColumn(mark, digest)
    same = F.col(options.get("source_col", "source")).cast("string").eqNullSafe(F.col(source))
    joined = marked.join(taken, mark).where(same)
    copy = common.unique_name(docs, "mix_copy")
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` mixed by sources weighing 1, 2, 3 in turn, at most 3 copies each."""
    out = decisions(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same in DuckDB, without bins: each source ordered whole.
OP8_SQL = r"""
WITH RECURSIVE narrow AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS skey,
    md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS digest,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sums AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM narrow GROUP BY skey),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM sums),
shares AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER r - cap))::DOUBLE / (sum(w) OVER () - (sum(w) OVER r - w))::DOUBLE AS share
  FROM weighed WINDOW r AS (ORDER BY cap / w, skey ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT skey, source_size, least(cap::DOUBLE, w * (SELECT share FROM shares WHERE share * w <= cap ORDER BY cap / w, skey LIMIT 1)) AS target FROM shares),
expected AS (
  SELECT n.*, t.source_size, t.target,
    CASE WHEN size > 0 AND source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS e,
    (('0x' || substr(digest, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM narrow n JOIN targets t USING (skey)),
odds AS (
  SELECT *, floor(e) AS certain,
    CASE WHEN e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM expected),
ranked AS (SELECT *, q / (1 + q) AS v FROM odds),
room AS (SELECT skey, max(target) - sum(certain * size) AS room FROM ranked GROUP BY skey),
steps AS (SELECT skey, v, sum(size) AS words FROM ranked WHERE v IS NOT NULL GROUP BY skey, v),
running AS (SELECT *, sum(words) OVER (PARTITION BY skey ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto FROM steps),
cuts AS (
  SELECT skey, min(v) AS cut, min_by(room - upto + words, v) AS room
  FROM running JOIN room USING (skey) WHERE upto > room GROUP BY skey),
after AS (SELECT skey, digest, v, sum(size) AS size, any_value(room) AS room FROM ranked JOIN cuts USING (skey) WHERE v >= cut GROUP BY skey, digest, v),
offer AS (SELECT skey, digest, size, row_number() OVER (PARTITION BY skey ORDER BY v, digest) AS place FROM after WHERE size <= room),
fold(skey, place, remaining, digest) AS (
  SELECT skey, 0::BIGINT, room::DOUBLE, NULL::VARCHAR FROM cuts
  UNION ALL
  SELECT skey, place, remaining, digest FROM (
    SELECT f.skey, o.place, f.remaining - o.size AS remaining, o.digest, row_number() OVER (PARTITION BY f.skey ORDER BY o.place) AS turn
    FROM fold f JOIN offer o ON o.skey = f.skey AND o.place > f.place AND o.size <= f.remaining) WHERE turn = 1),
extra AS (SELECT DISTINCT skey, digest FROM fold WHERE digest IS NOT NULL)
SELECT r.doc_id, r.size, r.source_size, r.target AS target,
  (r.size * (r.certain + CASE WHEN r.v IS NOT NULL AND (c.cut IS NULL OR r.v < c.cut OR x.digest IS NOT NULL) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked r LEFT JOIN cuts c USING (skey) LEFT JOIN extra x ON x.skey = r.skey AND x.digest = r.digest
"""
