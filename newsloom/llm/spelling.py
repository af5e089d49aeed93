"""Spelling variant grouping: words one edit apart, found by automata over broadcast trie shards.

A pass over the texts counts words (tasks add up what they can before the shuffle). The frequent words, in order, are cut
into shards of a bounded number of words, and a task makes each shard a compact trie: unary paths are one edge. Shards
are broadcast in waves of a bounded size, so that what is sent at a time doesn't grow with the vocabulary. In a wave each
word's Levenshtein automaton of distance one walks every shard depth-first: until the edit is spent it follows the word's
own path and tries each edit at each place of it; afterwards only the exact rest can be accepted. Neighbours are emitted
as rows, and Spark reduces them to counts and the best form of each word.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]
#: In Latin-1: letters of the contract stay (A-Z lower-cased), all else parts words.
_TABLE = bytes(ord(chr(c).lower()) if 0x41 <= c <= 0x5A else c if c in _LETTERS else 0x20 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_TABLE).split() if text else []


def slipped(run: bytes, prefix: int, every: int) -> bytes:
    """The run as written: one letter is lost where ``every`` divides the crc32 of '<doc_id>:<run>' (crc of the prefix given)."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_batches(least_length: int, every: int, limit: int):
    """(doc_id, text) -> (word, n): sums of a task, sent on whenever ``limit`` words are held."""

    def table(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[bytes, int] = {}
                for w in runs(text):
                    own[w] = own.get(w, 0) + 1
                prefix = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
                for w, n in own.items():
                    if every:
                        w = slipped(w, prefix, every)
                    if len(w) >= least_length:
                        held[w] = held.get(w, 0) + n
                if len(held) >= limit:
                    yield table(held)
                    held = {}
        if held:
            yield table(held)

    return run


def word_counts(docs: DataFrame, least_n: int = 5, least_length: int = 6, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of ``least_length`` letters and ``least_n`` occurrences or more.

    ``every`` (0 for never) plants slips as ``slipped`` has them. Null and empty texts have no words, a null id counts as
    an empty one, rows that repeat an id count each. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = base.mapInArrow(_count_batches(least_length, every, 200_000), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class Trie:
    """A compact trie of words with counts: node -> {first letter: (edge label, node)}, node -> count of the word that ends there."""

    def __init__(self, words: list[tuple[str, int]]):
        self.edges: list[dict[str, tuple[str, int]]] = [{}]
        self.ends: dict[int, int] = {}
        for word, n in words:
            self._insert(word, n)

    def _node(self, edges: dict[str, tuple[str, int]]) -> int:
        self.edges.append(edges)
        return len(self.edges) - 1

    def _insert(self, word: str, n: int) -> None:
        node, at = 0, 0
        while at < len(word):
            found = self.edges[node].get(word[at])
            if found is None:
                leaf = self._node({})
                self.edges[node][word[at]] = (word[at:], leaf)
                node, at = leaf, len(word)
                break
            label, child = found
            same = 1
            while same < len(label) and at + same < len(word) and label[same] == word[at + same]:
                same += 1
            if same < len(label):
                child_of = self._node({label[same]: (label[same:], child)})
                self.edges[node][word[at]] = (label[:same], child_of)
                child = child_of
            node, at = child, at + same
        self.ends[node] = n

    def exact(self, node: int, word: str, at: int) -> int | None:
        """The node where ``word[at:]`` ends a word; None if it leaves the trie or ends none."""
        edges = self.edges
        while at < len(word):
            found = edges[node].get(word[at])
            if found is None or not word.startswith(found[0], at):
                return None
            node, at = found[1], at + len(found[0])
        return node if node in self.ends else None

    def _rest(self, label: str, done: int, child: int, word: str, at: int) -> int | None:
        """As ``exact``, from within an edge of which ``done`` letters are walked."""
        left = len(label) - done
        if left > len(word) - at or not word.startswith(label[done:], at):
            return None
        return self.exact(child, word, at + left)

    def near(self, word: str) -> dict[str, int]:
        """Words at distance one and their counts: the automaton's states are (node, place in the word), edit unspent."""
        out: dict[str, int] = {}
        stack = [(0, 0)]
        while stack:
            node, at = stack.pop()
            head = word[:at]
            # The word's letter at this place is left out.
            if at < len(word):
                end = self.exact(node, word, at + 1)
                if end is not None:
                    out[head + word[at + 1 :]] = self.ends[end]
            for first, (label, child) in self.edges[node].items():
                # The first letter of the edge is put in, or stands for the word's letter.
                end = self._rest(label, 1, child, word, at)
                if end is not None:
                    out[head + first + word[at:]] = self.ends[end]
                if at >= len(word):
                    continue
                if first != word[at]:
                    end = self._rest(label, 1, child, word, at + 1)
                    if end is not None:
                        out[head + first + word[at + 1 :]] = self.ends[end]
                    continue
                # The same at each later place of the edge, as far as edge and word agree.
                same = 1
                while same < len(label):
                    here = at + same
                    head_in = word[:here]
                    if here < len(word):
                        end = self._rest(label, same, child, word, here + 1)
                        if end is not None:
                            out[head_in + word[here + 1 :]] = self.ends[end]
                        if label[same] != word[here]:
                            end = self._rest(label, same + 1, child, word, here + 1)
                            if end is not None:
                                out[head_in + label[same] + word[here + 1 :]] = self.ends[end]
                    end = self._rest(label, same + 1, child, word, here)
                    if end is not None:
                        out[head_in + label[same] + word[here:]] = self.ends[end]
                    if here >= len(word) or label[same] != word[here]:
                        break
                    same += 1
                else:
                    stack.append((child, at + same))
        out.pop(word, None)
        return out


def _shard_batches(shard: int):
    """Sorted (word, n) -> tries of up to ``shard`` words, pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []

        def made() -> pa.RecordBatch:
            t = Trie(held)
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([len(held)], pa.int64()), pa.array([pickle.dumps((t.edges, t.ends), -1)], pa.binary())], ["first", "words", "trie"])

        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(pair)
                if len(held) == shard:
                    yield made()
                    held = []
        if held:
            yield made()

    return run


#: The tries of the wave that a Python worker has last seen, so that its next tasks need not load them again.
_loaded: dict[str, list[Trie]] = {}


def _tries(sent, wave: str) -> list[Trie]:
    if wave not in _loaded:
        _loaded.clear()
        tries = []
        for blob in sent.value:
            t = Trie([])
            t.edges, t.ends = pickle.loads(blob)
            tries.append(t)
        _loaded[wave] = tries
    return _loaded[wave]


def _near_batches(sent, wave: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = _tries(sent, wave)
        for batch in batches:
            word, near, near_n = [], [], []
            for w in batch.column(0).to_pylist():
                for t in tries:
                    found = t.near(w)
                    word += [w] * len(found)
                    near += found
                    near_n += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(near_n, pa.int64())], ["word", "near", "near_n"])

    return run


def neighbours(words: DataFrame, shard: int = 65_536, wave: int = 131_072, task: int = 8_192) -> DataFrame:
    """word, near, near_n: all pairs of words (word, n) that differ by one inserted, deleted or replaced code point.

    Words may hold any code points; rows without a word are left out, an empty table gives none. A broadcast holds the
    tries of ``wave`` words at most and is gone before the next; a longer vocabulary takes more waves. A task asks for the
    neighbours of about ``task`` words.
    """
    spark = words.sparkSession
    words = common.materialise(words.where("word is not null").select("word", "n"), "words")
    many = words.count()
    # Few ranges, however many partitions the session makes of them.
    ranges = -(-many // shard) or 1
    ordered = words.repartitionByRange(ranges, "word").coalesce(ranges).sortWithinPartitions("word")
    shards = common.materialise(ordered.mapInArrow(_shard_batches(min(shard, wave)), "first string, words long, trie binary"), "shards")
    waves, held = [[]], 0
    # The list of shards, a row for many thousand words each, says which ones make a wave.
    for r in sorted(shards.select("first", "words").collect()):
        if waves[-1] and held + r.words > wave:
            waves.append([])
            held = 0
        waves[-1].append(r.first)
        held += r.words
    dealt, found = words.repartition(-(-many // task) or 1).select("word"), []
    for firsts in waves:
        sent = spark.sparkContext.broadcast([r.trie for r in shards.where(F.col("first").isin(firsts)).select("trie").collect()])
        found.append(common.materialise(dealt.mapInArrow(_near_batches(sent, uuid.uuid4().hex), "word string, near string, near_n long"), "near"))
        sent.destroy()
    common.release(shards)
    return reduce(DataFrame.unionByName, found)


def spelling_forms(words: DataFrame, ratio: int = 5, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n; words are distinct).

    ``form`` is the most frequent near word (ties: the least in code-point order) if it is ``ratio`` (2 or more) times as
    frequent, ``root`` the last form of forms from a word, or the word itself. An empty table gives none.
    """
    words = common.materialise(words.select("word", "n"), "counted")
    best = neighbours(words, **options).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = words.join(best, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    formed = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    formed = common.materialise(formed, "formed")
    # Chains of forms, followed by doubling: counts grow by the ratio at each step, so 63 steps are more than there are.
    ahead = common.materialise(formed.where("form is not null").select("word", F.col("form").alias("root")), "ahead")
    for _ in range(6):
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = common.materialise(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "ahead")
        if ahead.where("more").isEmpty():
            break
        ahead = ahead.drop("more")
    return formed.join(ahead.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all ``documents``."""
    return spelling_forms(word_counts(common.table(spark, sf_dir, "documents")))


#: The same in DuckDB. Letters beyond ASCII become single bytes before ``levenshtein``, which counts bytes.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
each AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM each GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END)) AS b FROM own),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || b, lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1]))) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
flat AS (
  SELECT word, n, length(word) AS l, translate(word, (SELECT string_agg(chr((191 + i)::INTEGER), '' ORDER BY i) FROM range(1, 65) r(i)), (SELECT string_agg(chr((32 + i)::INTEGER), '' ORDER BY i) FROM range(1, 65) r(i))) AS w FROM words),
near AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM flat x JOIN flat y ON y.l IN (x.l - 1, x.l, x.l + 1) AND x.word <> y.word AND levenshtein(x.w, y.w) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
follow AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT f.word, f.next, g.form FROM follow f JOIN formed g ON f.next = g.word)
SELECT word, form, (SELECT root FROM follow f WHERE f.word = formed.word AND f.next IS NULL) AS root, n, n_near, form_n FROM formed
"""
