"""Near-duplicate detection: fast similarity sketching, banding, exact verification, components.

Sketch: Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching" (2017). With ``t`` coordinates, round i < t
throws every element into bin h_i(x) mod t with value (i, h_i(x)); round i >= t throws every element into bin i - t.
Each bin keeps its least value, so rounds stop when all bins are full. Unlike one-permutation hashing no bin stays
empty, and the agreement of two sketches concentrates about the Jaccard similarity as that of t independent
minimums does (Chernoff bounds hold). ``t * ln t`` elements fill the bins in about one round.

Plan. One Arrow pass gives each document a digest of its word sequence and a sketch. Exact copies collapse to one
class by digest before anything is paired. Each band of ``rows`` coordinates of a class is a key. Keys are never
expanded into all their pairs: members pair with pivots of their keys, each member's best pair is verified on full
shingle sets, and components absorb the group. After two rounds only keys that still hold several components are
compared member by member, in tiles of a bounded size that tasks share. A tile settles pairs of short texts on their
sets, one link for each other component, and of longer texts returns those whose longer sketches agree, to be verified.
So every candidate pair of the banding is either verified or already joined through verified links. Components are computed on tables, never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import common

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        import xxhash

        self._hash, self._limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        value = self[word] = self._hash(word)
        return value


def shingle_hashes(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word k-shingles; fewer words make one shingle; none make none."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * _M1 + w[i : len(w) - n + 1 + i] + _GOLD)
    return np.unique(h)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit hashes (sorted and distinct); 16 bits of each of t values."""
    out = np.empty(t, np.uint64)
    filled = np.zeros(t, bool)
    for i in range(2 * t):
        h = mix(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if i < t:
            bins, value = (h % np.uint64(t)).astype(np.int64), h
        else:
            bins, value = np.full(len(h), i - t), h
        if i:
            at = ~filled[bins]
            bins, value = bins[at], value[at]
        if len(bins):
            order = np.argsort(value)[::-1]
            bins = bins[order]
            out[bins] = mix(value[order] + np.uint64(i))  # the least value is written last
            filled[bins] = True
        if filled.all():
            break
    return (out & np.uint64(0xFFFF)).astype(np.uint16)


def _sketch_batches(k: int, t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            digests, counts, sketches = [], [], []
            for text in batch.column(2).to_pylist():
                words = common.words(text)
                elements = shingle_hashes(words, k, hashes)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                counts.append(len(elements))
                sketches.append(sketch(elements, t).tobytes() if len(elements) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(sketches, pa.binary())],
                ["doc_id", "text_hash", "digest", "n_shingles", "sketch"],
            )

    return run


def _sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _band_batches(bands: int, rows: int):
    """One row per class and band: (key, band, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _sketch_matrix(batch.column(1)).astype(np.uint64)
            key = np.zeros((len(m), bands), np.uint64) + mix(np.arange(bands, dtype=np.uint64) + _GOLD)
            for r in range(rows):
                key = mix(key * _M2 + m[:, r : bands * rows : rows])
            nodes = batch.column(0).take(pa.array(np.repeat(np.arange(len(m)), bands)))
            band = np.tile(np.arange(bands, dtype=np.int32), len(m))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), nodes], ["key", "band", "node"])

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sketch, sketch) -> (a, b, coordinates in which they agree)."""
    for batch in batches:
        agree = (_sketch_matrix(batch.column(2)) == _sketch_matrix(batch.column(3))).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree, pa.int32())], ["a", "b", "agree"])


def _fine_batches(k: int, t: int):
    """(node, text) -> (node, its size, and a longer sketch or, if that is no longer, the set itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(common.words(x), k, hashes) for x in batch.column(1).to_pylist()]
            fine = [x.tobytes() if 4 * len(x) <= 2 * t else sketch(x, t).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(fine, pa.binary())], ["node", "size", "fine"])

    return run


def _tile_pairs(least: int, fine: int, fine_least: int, bands: int, percent: int):
    """Of one tile: pairs of different components that may be similar, each at its first shared band only.

    Two short texts bring their sets, so their pair is settled here (sure); others are candidates by their sketches.
    """

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        side, size = tile.column("side").to_numpy(), tile.column("size").to_numpy()
        nodes, labels = tile.column("node").to_pylist(), np.unique(tile.column("label").to_pylist(), return_inverse=True)[1]
        m = _sketch_matrix(tile.column("sketch").chunk(0))
        blobs = tile.column("fine").to_pylist()
        short = 4 * size <= 2 * fine
        longer = np.zeros((len(nodes), fine), np.uint16)
        for i in np.flatnonzero(~short):
            longer[i] = np.frombuffer(blobs[i], np.uint16)
        # One number for each shingle of the tile's short texts, so that intersections are counts.
        flat = np.concatenate([np.frombuffer(blobs[i], np.uint64) for i in np.flatnonzero(short)] or [np.empty(0, np.uint64)])
        owner = np.repeat(np.flatnonzero(short), size[short])
        names, number = np.unique(flat, return_inverse=True)
        order = np.argsort(number, kind="stable")
        by_shingle, begins = owner[order], np.searchsorted(number[order], np.arange(len(names) + 1))
        stops = np.cumsum(np.where(short, size, 0))
        band = tile.column("band")[0].as_py()
        right = np.flatnonzero(side != 0)
        out: list[tuple[int, int, bool]] = []
        for i in np.flatnonzero(side != 1):
            at = right[labels[right] != labels[i]]
            if side[i] == 2:
                at = at[(side[at] != 2) | (at > i)]
            same = m[at] == m[i]
            near = same.sum(1) >= least
            at, same = at[near], same[near]
            if not len(at):
                continue
            at = at[same.reshape(len(at), bands, -1).all(2).argmax(1) == band]
            exact = at[short[at]] if short[i] else at[:0]
            if len(exact):
                own = number[stops[i] - size[i] : stops[i]]
                both = np.bincount(np.concatenate([by_shingle[begins[x] : begins[x + 1]] for x in own]), minlength=len(nodes))[exact]
                linked = exact[100 * both >= percent * (size[i] + size[exact] - both)]
                # One link to each other component says all.
                out += [(i, j, True) for j in linked[np.unique(labels[linked], return_index=True)[1]]]
            rest = at[~short[at] & ~short[i]]
            out += [(i, j, False) for j in rest[(longer[rest] == longer[i]).sum(1) >= fine_least]]
            out += [(i, j, False) for j in at[short[at] != short[i]]]
        pairs = [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), sure) for i, j, sure in out]
        return pa.table({"a": pa.array([x for x, _, _ in pairs], pa.binary()), "b": pa.array([x for _, x, _ in pairs], pa.binary()), "sure": pa.array([x for _, _, x in pairs], pa.bool_())})

    return run


def least_agreement(t: int, percent: int) -> int:
    """Coordinates in which a pair at the similarity agrees but for five standard deviations."""
    p = percent / 100
    return max(0, int(t * p - 5 * (t * p * (1 - p)) ** 0.5))


def _verify_batches(k: int, percent: int):
    """(a, b, text of a, text of b) -> pairs whose full shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last: tuple[object, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for b, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if last[0] != b:
                    last = (b, shingle_hashes(common.words(text_b), k, hashes))
                x, y = shingle_hashes(common.words(text_a), k, hashes), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id of an edge table (a, b).

    Alternating large-star and small-star steps (Kiveris et al. 2014) on tables; the edge count never grows, rounds are
    logarithmic in practice, and each round is written to the shared folder. A round that changes nothing is the last.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = common.materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(current)
    while seen[0]:
        # Large star: every neighbour larger than u is linked to the least of u's neighbourhood.
        near = both(current)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: u and its smaller neighbours are linked to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = common.materialise(small.where("a <> b").distinct(), "cc")
        common.release(current)
        current, before, seen = after, seen, mark(after)
        if seen == before:
            break
    # Stars: each node points to its least; the least points to itself.
    nodes = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    fine: int = 640,
    tile: int = 1024,
    with_hash: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``; ``with_hash`` adds the hash of its text.

    Documents with ``100 * |A & B| >= percent * |A | B|`` on word k-shingle sets are linked; a component's id is its
    least doc_id, and kept says that the row carries it. A pair at the similarity 0.8 shares no band with probability
    (1 - 0.8**5)**32 < 4e-6; sketch filters (of 160, and later of ``fine``, coordinates) are set five standard deviations
    below the similarity and lose such a pair with a probability of about 1e-6.

    Null, empty and blank texts have n_shingles 0, link with nothing and are kept. A row without doc_id links with
    nothing, has a null component_id and is kept. Rows that repeat a doc_id are judged each by its own text. Equal rows
    give equal results. An empty table gives none. Other columns are ignored, whatever their names.
    """
    t = bands * rows
    least = least_agreement(t, percent)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = base.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, digest binary, n_shingles long, sketch binary"
    sketched = common.materialise(hashed.mapInArrow(_sketch_batches(k, t), schema), "sketched")
    alive = sketched.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = alive.groupBy(F.col("digest").alias("node")).agg(F.min(F.struct("doc_id", "text_hash", "sketch")).alias("rep"))
    classes = common.materialise(classes.select("node", "rep.*"), "classes")
    sketches = classes.select("node", "sketch")
    keys = sketches.mapInArrow(_band_batches(bands, rows), "key long, band int, node binary")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = common.materialise(keys.join(shared, "key", "left_semi"), "keys")
    # Texts of the classes that share a key with another; only these are ever compared.
    wanted = classes.join(keys.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash")
    wanted = wanted.withColumn("_h", F.col("text_hash")).drop("text_hash")
    texts = hashed.where("text is not null").join(wanted, "doc_id").where("text_hash = _h").select("node", "text").dropDuplicates(["node"])
    texts = common.materialise(texts, "texts")

    def with_sketches(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
        return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agreement, "a binary, b binary, agree int").where(F.col("agree") >= least)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        return pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verify_batches(k, percent), "a binary, b binary")

    def best_links(pairs: DataFrame) -> DataFrame:
        """Of each node's pivots the one whose sketch agrees most, if the texts are similar indeed."""
        best = with_sketches(pairs.distinct()).groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))
        return common.materialise(verified(best), "edges")

    # First three pivots for each key, alike for all its members; then, in keys that still hold several components, the
    # node with most links so far.
    pivots = keys.groupBy("key").agg(F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", F.xxhash64("node")))).alias("b"))
    edges = best_links(keys.join(pivots, "key").select(F.col("node").alias("a"), F.explode("b").alias("b")).where("a <> b"))
    labels = connected_components(edges)
    members = common.materialise(_labelled(keys, labels, edges), "members")
    hubs = members.groupBy("key").agg(F.max_by(F.struct("label", "node"), F.struct("degree", "node")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    hubs = hubs.where("lo <> hi").select("key", F.col("p.node").alias("b"), F.col("p.label").alias("label_b"))
    more = best_links(members.withColumnRenamed("node", "a").join(hubs, "key").where("label <> label_b").select("a", "b"))
    stars = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    labels = connected_components(stars.unionByName(more))
    members = common.materialise(_labelled(keys, labels, more), "members")
    # What is left: keys with several components, compared in tiles.
    mixed = members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = mixed.where("lo <> hi").select("key", F.ceil(F.col("n") / tile).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    mixed_members = common.materialise(members.join(mixed, "key").withColumn("block", block), "mixed")
    finer = texts.join(mixed_members.select("node").distinct(), "node", "left_semi").select("node", "text")
    finer = common.materialise(finer.mapInArrow(_fine_batches(k, fine), "node binary, size long, fine binary").join(sketches, "node"), "fine")
    dealt = mixed_members.select("key", "band", "node", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "key", "band", "node", "label", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    ).join(finer, "node")
    tiles = dealt.groupBy("key", "ti", "tj").applyInArrow(_tile_pairs(least, fine, least_agreement(fine, percent), bands, percent), "a binary, b binary, sure boolean")
    tiles = common.materialise(tiles, "tiles")
    rest = verified(tiles.where("not sure").select("a", "b").distinct()).unionByName(tiles.where("sure").select("a", "b").distinct())
    rest = common.materialise(rest, "edges")
    if not rest.isEmpty():
        stars = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
        labels = connected_components(stars.unionByName(rest))
    # The least doc_id of each component, carried back to every row through its digest.
    named = classes.select("node", "doc_id").join(labels.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least_id = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = common.materialise(named.join(least_id, "component").select(F.col("node").alias("digest"), "component_id"), "named")
    also = ["text_hash"] if with_hash else []
    linked = sketched.where("digest is not null and doc_id is not null").join(named, "digest").select("doc_id", *also, "n_shingles", "component_id")
    alone = sketched.where("digest is null or doc_id is null").select("doc_id", *also, "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the least id. Columns and names stay.

    Rows without words, and rows without an id, are all kept. Of rows that repeat an id as well as the words one is kept.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, with_hash=True, **options)
    i, h = (common.unique_name(docs, x) for x in ("kept_id", "kept_hash"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    text_hash = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    rest = docs.join(gone, (F.col(f"`{id_col}`").cast("long") == F.col(i)) & (text_hash == F.col(h)), "left_anti")
    # Only ids that occur more than once can still stand twice for a group.
    again = found.where("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count("*").alias("n")).where("n > 1")
    again = common.materialise(again.select(F.col("doc_id").alias(i)).distinct(), "again")
    if again.isEmpty():
        return rest
    twice = F.col(f"`{id_col}`").cast("long") == F.col(i)
    words = common.unique_name(docs, "kept_words")
    joined = F.trim(F.regexp_replace(F.translate(F.col(f"`{text_col}`").cast("string"), common.ASCII_UPPER, common.ASCII_LOWER), r"[\x20\x09-\x0D]+", " "))
    # Of one id, rows linked to each other share the component, so one of them may stay; the least words by hash.
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(words))
    some = rest.join(again, twice, "left_semi").withColumn(words, F.xxhash64(joined))
    blank = some.where(joined == "").drop(words)
    best = some.where(joined != "").withColumn(i, place).where(F.col(i) == 1).drop(words, i)
    return rest.join(again, twice, "left_anti").unionByName(best).unionByName(blank)


def _labelled(keys: DataFrame, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys' members with their component and their number of verified links."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    known = labels.withColumnRenamed("id", "node").join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node", "left")
    out = keys.join(known, "node", "left")
    return out.select("key", "band", "node", F.coalesce("component", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of ``documents`` by word 4-shingles at similarity 0.8."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=4)


#: The same in DuckDB: every pair that shares a shingle, on full sets.
OP7_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) END AS shingles FROM docs),
sized AS (SELECT doc_id, shingles, len(shingles)::BIGINT AS n FROM sets),
each AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM sized),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM each x JOIN each y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(least, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(least, s.doc_id)) AS kept
FROM sized s LEFT JOIN least_id USING (doc_id)
"""
