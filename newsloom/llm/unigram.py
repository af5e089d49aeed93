"""Token counts of a unigram tokenizer, without making tokens: count-only Viterbi.

An Aho-Corasick automaton of the vocabulary lists, for each end position of a word, the pieces that end there; dynamic
programming carries the best score and the number of pieces. Ties follow the tokenizers library: of equal scores the
path whose last piece starts first stands. A character that no piece covers alone may be unknown, at the least score
minus 10, and neighbouring unknowns of a word are one token. The library splits texts at white space and writes a mark before
each word, so words are independent and a word's count is remembered; texts are then sums over word counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import common

MARK = "▁"
#: What Unicode calls white space; Python's split also takes 1C-1F, which are ordinary characters here.
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_EXTRA = re.compile(r"[\x1c-\x1f]")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces and scores of a sentencepiece model file, without control, byte and white-space pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in n if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(p, s) for p, s in pieces if set(p) != {MARK} or len(p) == 1]


class PieceCounter:
    """word -> (tokens, score), remembered up to ``limit`` words."""

    def __init__(self, vocab: list[tuple[str, float]], limit: int = 500_000):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min((s for _, s in vocab), default=0.0) - 10.0
        self._known: dict[str, tuple[int, float]] = {}
        self._limit = limit

    def word(self, word: str) -> tuple[int, float]:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= self._limit:
                self._known.clear()
            found = self._known[word] = self._viterbi(MARK + word)
        return found

    def _viterbi(self, text: str) -> tuple[int, float]:
        n = len(text)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: dict[int, list[tuple[int, float]]] = {}
        for last, piece in self._automaton.iter(text):
            ends.setdefault(last + 1, []).append(piece)
        for end in range(1, n + 1):
            best, start, single = None, -1, False
            for length, own in sorted(ends.get(end, ()), reverse=True):  # the earliest start first
                single |= length == 1
                s = score[end - length] + own
                if best is None or s > best:
                    best, start = s, end - length
            if not single:
                s = score[end - 1] + self._unknown
                if best is None or s > best:
                    score[end], unknown[end] = s, True
                    count[end] = count[end - 1] + (not unknown[end - 1])
                    continue
            score[end], count[end] = best, count[start] + 1
        return count[n], score[n]

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = [w for w in _SPACE.split(text) if w] if _EXTRA.search(text) else text.split()
        tokens, score = 0, 0.0
        for word, n in Counter(words).items():
            t, s = self.word(word)
            tokens += n * t
            score += n * s
        return tokens, score


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(vocabulary(path))
        for batch in batches:
            found = [counter.text(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t for t, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], [*batch.schema.names[:-1], "n_tokens", "best_score"])

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, best_score: one row per row of ``docs``.

    Null, empty and blank texts have 0 tokens and score 0. Ids may be null or repeat. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([src.schema.fields[0], T.StructField("n_tokens", T.LongType()), T.StructField("best_score", T.DoubleType())])
    return src.mapInArrow(_count_batches(model_path), schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a unigram tokenizer of the public 32k pieces and their scores."""
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
