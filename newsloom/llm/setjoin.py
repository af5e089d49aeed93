"""N-gram Jaccard join: an exact similarity self-join in the metric space of shingle sets.

The Jaccard distance is a metric, so pivots can part the documents into Voronoi regions: a document is at home with its
nearest pivot, and the triangle inequality says which others it may be linked across. With links up to distance e, the
partner of a document at home with pivot p lies at most 2e nearer to its own pivot than to p; documents within that window
are replicated to the region of p. Documents beyond ``FAR`` of all pivots make a region of their own, with those that are
beyond ``FAR`` - e. Regions above ``leaf`` are parted again by pivots of their own. Each document finds all its partners in
the region where it is at home, so nothing is lost and nothing counted twice.

Before the first pivots are drawn, documents that can link with nothing leave: two sets that differ in D elements at most
agree in one of D + 1 parts of the hash space (a part's key is the sum of its hashes). Documents connected by equal parts
are the first regions; documents of different regions are certainly further apart than e. Equal sets are one class.

A region that pivots can't part (all its members within reach of each other) is compared as it is: its members are dealt
into blocks of a bounded size, a task multiplies the incidence matrices of two blocks, and returns each document's number
of links and one edge to the group it meets there, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm.minhash import WordHashes, connected_components, mix, shingle_hashes

#: Distance beyond which a document is at home with no pivot.
FAR = 0.8
#: Rows of a broadcast, of less than 100 bytes each.
SENT = 300_000
_SALT = 0x9E3779B97F4A7C15


def size_buckets(percent: int, growth: float = 1.4, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the buckets of set sizes, and each one's number of parts: more than linked sets can differ in."""
    begins = [1]
    while begins[-1] < largest:
        begins.append(max(begins[-1] + 1, int(begins[-1] * growth)))
    ends = np.array(begins[1:], np.int64) - 1
    return np.array(begins[:-1], np.int64), 2 * ends * (100 - percent) // (100 + percent) + 1


@lru_cache(256)
def _cuts(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def part_keys(elements: np.ndarray, bucket: int, parts: int, rounds: int = 4) -> np.ndarray:
    """Keys of a set (sorted 64-bit hashes) in ``parts`` parts: equal sets of one part have equal keys.

    A part that is empty says nothing, so a set with empty parts is parted anew by other hashes, where it meets the sets
    that have the same empty parts; after ``rounds`` such parts stay keys.
    """
    cuts, out, h = _cuts(parts), [], elements
    for i in range(rounds):
        at = np.concatenate([[0], np.searchsorted(h, cuts), [len(h)]])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(_SALT)))])
        keys = mix(sums[at[1:]] - sums[at[:-1]] + mix(np.arange(parts, dtype=np.uint64) + np.uint64((bucket + 1) * 1_000_003 * (i + 1))))
        full = at[1:] > at[:-1]
        if full.all() or i == rounds - 1:
            return np.concatenate([*out, keys])
        out.append(keys[full])
        h = np.sort(mix(elements + np.uint64(_SALT * (i + 2) & 0xFFFFFFFFFFFFFFFF)))


def _key_batches(k: int, percent: int):
    """(doc_id, text_hash, text) -> (doc_id, text_hash, node, size, keys); node is the digest of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, (begins, parts) = WordHashes(), size_buckets(percent)
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column(2).to_pylist():
                x = shingle_hashes(common.words(text), k, hashes)
                sizes.append(len(x))
                nodes.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                own: list[np.ndarray] = []
                if len(x):
                    # A pair meets in the bucket of its larger set: one's own, and those that hold larger partners.
                    low, high = np.searchsorted(begins, [len(x), 100 * len(x) // percent], "right") - 1
                    own = [part_keys(x, b, int(parts[b])) for b in range(low, high + 1)]
                keys.append(np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "text_hash", "node", "size", "keys"])

    return run


def _set_batches(k: int):
    """(region, node, weight, text) -> members with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(common.words(x), k, hashes) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([True] * len(sets), pa.bool_()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                ["region", "node", "weight", "home", "size", "elements"],
            )

    return run


MEMBER = "region long, node binary, weight long, home boolean, size long, elements binary"


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set with each, (left, right); the right may be the left.

    Elements that few pairs share are counted pair by pair, others by products of slices of the incidence matrices.
    """
    out = np.zeros((len(left), len(right)), np.int32)
    sides = []
    for sets in (left, right):
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        names, begins, counts = np.unique(flat[order], return_index=True, return_counts=True)
        sides.append((names, begins, counts, owner[order]))
    (names_l, begin_l, count_l, owner_l), (names_r, begin_r, count_r, owner_r) = sides
    _, i, j = np.intersect1d(names_l, names_r, assume_unique=True, return_indices=True)
    pairs = count_l[i] * count_r[j]
    few = pairs <= 64
    # Few: of each element all its owners left by all its owners right.
    a, b, n = i[few], j[few], pairs[few]
    for at in range(0, len(a), 65_536):
        sl = slice(at, at + 65_536)
        element = np.repeat(np.arange(len(n[sl])), n[sl])
        place = np.arange(len(element)) - np.repeat(np.cumsum(n[sl]) - n[sl], n[sl])
        width = count_r[b[sl]][element]
        np.add.at(out, (owner_l[begin_l[a[sl]][element] + place // width], owner_r[begin_r[b[sl]][element] + place % width]), 1)
    a, b = i[~few], j[~few]
    for at in range(0, len(a), 1024):
        sl = slice(at, at + 1024)

        def incidence(n_sets, at_names, begins, counts, owner):
            m = np.zeros((n_sets, len(at_names)), np.float32)
            column = np.repeat(np.arange(len(at_names)), counts[at_names])
            place = np.arange(len(column)) - np.repeat(np.cumsum(counts[at_names]) - counts[at_names], counts[at_names])
            m[owner[begins[at_names][column] + place], column] = 1
            return m

        out += (incidence(len(left), a[sl], begin_l, count_l, owner_l) @ incidence(len(right), b[sl], begin_r, count_r, owner_r).T).astype(np.int32)
    return out


def _compare(left: pd.DataFrame, right: pd.DataFrame, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a tile: (for each left, for each right) the weight of its partners, and the link matrix.

    Pairs without a document at home are somebody else's. With ``same`` both sides are one block.
    """
    unpack = lambda side: [np.frombuffer(x, np.uint64) for x in side["elements"]]
    a = unpack(left)
    both = intersections(a, a if same else unpack(right)).astype(np.int64)
    size_l, size_r = left["size"].to_numpy(), right["size"].to_numpy()
    linked = 100 * both >= percent * (size_l[:, None] + size_r[None, :] - both)
    home_l, home_r = left["home"].to_numpy(bool), right["home"].to_numpy(bool)
    linked &= home_l[:, None] | home_r[None, :]
    if same:
        np.fill_diagonal(linked, False)
    return (linked * right["weight"].to_numpy()[None, :]).sum(1) * home_l, (linked * left["weight"].to_numpy()[:, None]).sum(0) * home_r, linked


def _roots(linked: np.ndarray, same: bool) -> np.ndarray:
    """The least index that each node of a link matrix is connected to; left nodes, then right ones, unless both are the same."""
    n = linked.shape[0]
    label = np.arange(n if same else n + linked.shape[1])
    i, j = np.nonzero(linked)
    j = j if same else j + n
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def tile_links(tile: pd.DataFrame, percent: int) -> pd.DataFrame:
    """node, links, root of a tile's documents: the partners found here, and the document that stands for its group here."""
    out = {"node": [], "links": [], "root": []}
    for _, own in tile.groupby("region", sort=False):
        own = own.sort_values("node")
        same = bool((own["side"] == 2).all())
        left, right = (own, own) if same else (own[own["side"] == 0], own[own["side"] == 1])
        to_left, to_right, linked = _compare(left, right, same, percent)
        nodes = np.array(left["node"].tolist() + ([] if same else right["node"].tolist()), object)
        links = to_left if same else np.concatenate([to_left, to_right])
        label = _roots(linked, same)
        met = np.bincount(label, minlength=len(nodes))[label] > 1
        out["node"] += nodes[met].tolist()
        out["links"] += links[met].tolist()
        out["root"] += nodes[label[met]].tolist()
    return pd.DataFrame({"node": pd.Series(out["node"], dtype=object), "links": pd.Series(out["links"], dtype="int64"), "root": pd.Series(out["root"], dtype=object)})


def _measure(e: float, salt: int):
    """Members of a region's chunk and all its pivots -> for each member its places in the regions of the pivots."""

    def run(key: tuple, members: pa.Table, pivots: pa.Table) -> pa.Table:
        region = key[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in pivots.column("p_elements").to_pylist()]
        names = pivots.column("p_node").to_pylist()
        order = np.argsort(np.array([n.hex() for n in names]), kind="stable")
        sets, names = [sets[i] for i in order], [names[i] for i in order]
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        sizes = np.array([len(s) for s in sets])
        ids = np.array([int.from_bytes(n[:8], "little") for n in names], np.uint64)
        cell = mix(ids ^ np.uint64(region & 0xFFFFFFFFFFFFFFFF) ^ mix(np.array([salt], np.uint64))).view(np.int64)
        far_cell = int(mix(np.array([region & 0xFFFFFFFFFFFFFFFF], np.uint64) + np.uint64(salt + 1)).view(np.int64)[0])
        row, to, home = [], [], []
        for r, (blob, at_home) in enumerate(zip(members.column("elements").to_pylist(), members.column("home").to_pylist(), strict=True)):
            x = np.frombuffer(blob, np.uint64)
            lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            n = hi - lo
            hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[hit], minlength=len(sets))
            far = 1 - both / (len(x) + sizes - both)
            least = far.min() if len(far) else 1.0
            # Slack for rounding only adds places.
            near = np.flatnonzero(far <= min(least + 2 * e, FAR + e) + 1e-9)
            own = int(far.argmin()) if least <= FAR else -1
            row += [r] * len(near)
            to += cell[near].tolist()
            home += (at_home & (near == own)).tolist()
            if least > FAR - e - 1e-9:
                row.append(r)
                to.append(far_cell)
                home.append(at_home and own < 0)
        return pa.table({"parent": pa.array([region] * len(row), pa.int64()), "region": pa.array(to, pa.int64()), "node": members.column("node").take(pa.array(row, pa.int64())), "home": pa.array(home, pa.bool_())})

    return run


def _sized(members: DataFrame) -> DataFrame:
    return members.groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.max(F.col("home").cast("int")).alias("any_home"))


def part(members: DataFrame, percent: int, leaf: int, pivots: int, chunk: int, replicas: float) -> tuple[DataFrame, DataFrame]:
    """Members of regions (``MEMBER``) parted until they are of ``leaf`` documents or can't be parted; and those regions' sizes.

    A region is kept whole if its parts would hold more than ``replicas`` times its documents, or one part nearly all of
    them. Levels are written to the shared folder. ``pivots`` is the expected number drawn in a region, by hash.
    """
    e = (100 - percent) / 100
    done, level = [], 0
    while True:
        sized = common.materialise(_sized(members), "regions")
        large = sized.where(F.col("n") > leaf)
        if large.isEmpty():
            done.append(members)
            break
        large = large.select("region", "n")
        done.append(members.join(large, "region", "left_anti"))
        work = members.join(large, "region")
        drawn = F.pmod(F.xxhash64("node", F.lit(level)), F.col("n")) < pivots
        drawn = work.where(drawn).select(F.col("region").alias("p_region"), F.col("node").alias("p_node"), F.col("elements").alias("p_elements"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
        drawn = drawn.withColumn("p_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        work = work.withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / chunk)).cast("int")).drop("n")
        placed = work.groupBy("region", "chunk").cogroup(drawn.groupBy("p_region", "p_chunk")).applyInArrow(_measure(e, level), "parent long, region long, node binary, home boolean")
        placed = common.materialise(placed, "placed")
        cells = placed.groupBy("parent", "region").agg(F.count("*").alias("n")).groupBy("parent").agg(F.sum("n").alias("n_all"), F.max("n").alias("n_most"))
        useful = large.join(cells, large["region"] == cells["parent"]).where((F.col("n_all") <= replicas * F.col("n")) & (F.col("n_most") <= 0.8 * F.col("n"))).select("parent")
        useful = common.materialise(useful, "useful")
        whole = large.join(useful, large["region"] == useful["parent"], "left_anti").select("region")
        done.append(members.join(whole, "region", "left_semi"))
        if useful.isEmpty():
            break
        # Regions where nobody is at home have no pairs of their own.
        placed = placed.join(useful, "parent", "left_semi")
        placed = placed.join(placed.where("home").select("region").distinct(), "region", "left_semi")
        sets = members.select(F.col("region").alias("parent"), "node", "weight", "size", "elements")
        members = common.materialise(placed.join(sets, ["parent", "node"]).select("region", "node", "weight", "home", "size", "elements"), "members")
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out, _sized(out).where("any_home = 1")


def set_join(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", leaf: int = 256, block: int = 2048, block_elements: int = 2_000_000, pivots: int = 32, chunk: int = 2048, replicas: float = 3.0) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id: one row per row of ``docs``.

    Rows with ``100 * |A & B| >= percent * |A | B|`` on word k-shingle sets (``percent`` above 60) are linked: n_links
    counts a row's partners, repeated rows each; component_id is the least doc_id reachable. Exact: no pair is missed.

    Null, empty and blank texts have n_shingles 0 and link with nothing. A row without doc_id links with nothing and has a
    null component_id. Rows that repeat a doc_id link each by its own text. Very long texts take part whole: their keys
    grow with their sets. An empty table gives none. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hashed = base.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    read = common.materialise(hashed.mapInArrow(_key_batches(k, percent), "doc_id long, text_hash long, node binary, size long, keys array<long>"), "sets")
    alive = read.where("node is not null and doc_id is not null")
    classes = alive.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "size", "keys")).alias("rep"), F.count("*").alias("weight"))
    classes = common.materialise(classes.select("node", F.xxhash64("node").alias("short"), "rep.*", "weight"), "classes")
    # Regions to begin with: classes connected by equal parts.
    keys = classes.select(F.explode("keys").alias("key"), "short")
    ends = keys.groupBy("key").agg(F.min("short").alias("lo"), F.max("short").alias("hi")).where("lo <> hi").select("key", "lo")
    edges = keys.join(ends, "key").where("short <> lo").select(F.col("short").alias("a"), F.col("lo").alias("b"))
    regions = connected_components(edges).select(F.col("id").alias("short"), F.col("component").alias("region"))
    wanted = classes.join(regions, "short").select("region", "node", "weight", "doc_id", F.col("text_hash").alias("_h"))
    wanted = common.materialise(wanted, "wanted")
    # Rows of three numbers and two digests: up to ``SENT`` of them are sent to the texts, more meet them in a shuffle.
    sent = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    texts = hashed.where("text is not null").join(sent, "doc_id").where("text_hash = _h").dropDuplicates(["node"]).select("region", "node", "weight", "text")
    members = common.materialise(texts.mapInArrow(_set_batches(k), MEMBER), "members")
    members, sized = part(members, percent, leaf, pivots, chunk, replicas)
    # Small regions share tasks; large ones are dealt into blocks, each block pair a tile.
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / block_elements)).cast("int")
    sized = sized.select("region", blocks.alias("blocks"), "n")
    small = F.col("blocks") == 1
    pack = F.when(small & (F.col("n") <= leaf), F.pmod(F.xxhash64("region"), F.lit(8 * common.partitions(docs.sparkSession)))).otherwise(F.col("region"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    dealt = members.join(sized, "region").select("region", "node", "weight", "home", "size", "elements", pack.alias("pack"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.withColumns({"ti": F.least("own", "other"), "tj": F.greatest("own", "other"), "side": side})
    found = dealt.groupBy("pack", "ti", "tj").applyInPandas(lambda tile: tile_links(tile, percent), "node binary, links long, root binary")
    found = common.materialise(found, "links")
    components = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "doc_id", "weight").join(components.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("node", "doc_id", "weight", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    counted = named.join(least, "component").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    counted = common.materialise(counted, "named")
    linked = alive.select("doc_id", "node", "size").join(counted, "node").select("doc_id", F.col("size").alias("n_shingles"), "n_links", "component_id")
    alone = read.where("node is null or doc_id is null").select("doc_id", F.col("size").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all ``documents`` on word 3-shingles at similarity 0.9."""
    return set_join(common.table(spark, sf_dir, "documents"))


#: The same in DuckDB: every pair that shares a shingle, on full sets.
OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) END AS shingles FROM docs),
sized AS (SELECT doc_id, shingles, len(shingles)::BIGINT AS n FROM sets),
each AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM sized),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM each x JOIN each y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT s.doc_id, s.n AS n_shingles, coalesce(c.n_links, 0)::BIGINT AS n_links, least(s.doc_id, coalesce(least, s.doc_id)) AS component_id
FROM sized s LEFT JOIN least_id USING (doc_id) LEFT JOIN counts c USING (doc_id)
"""
