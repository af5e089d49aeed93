"""Language identification by mixture inference.

Model: each language is a multinomial over hashed character n-grams (lengths 1 to 4, words padded with boundaries),
counted on executors over a bounded sample of labelled documents. A word's likelihood in a language is the product over
its n-grams, tempered by their number since they overlap. A document is a bag of words drawn from a mixture of
languages; expectation-maximisation estimates the proportions, and the set of languages is chosen by penalised
likelihood: from the best single language on, the language that helps most is added while twice the gain in
log-likelihood exceeds ``penalty * ln(words)``.

Scoring keeps the word likelihoods of an executor in one table that is cleared when it is full; documents of a batch
run through EM together as one sparse problem.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import common

_LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
LONGEST_GRAM, PIECE = 4, 60


def text_words(text: str | None) -> Counter:
    """Lower-cased runs of letters and their counts.

    Runs of more than ``PIECE`` letters, as in scripts without spaces, count as pieces of so many at most, which overlap
    by three letters so that no n-gram is lost.
    """
    bag = Counter(_LETTERS.findall(text.lower())) if text else Counter()
    overlap = LONGEST_GRAM - 1
    if max(map(len, bag), default=0) > PIECE:
        for w in [w for w in bag if len(w) > PIECE]:
            n = bag.pop(w)
            for i in range(0, len(w) - overlap, PIECE - overlap):
                bag[w[i : i + PIECE]] += n
    for w in [w for w in bag if not w.isalpha() and not any(map(str.isalpha, w))]:  # runs of other numerals
        del bag[w]
    return bag


def gram_ids(words: list[str], longest: int = LONGEST_GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character n-gram of each word, and each word's number of n-grams."""
    codes = [np.frombuffer(f"\x02{w}\x03".encode("utf-32-le", "replace"), np.uint32) for w in words]
    lengths = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate(codes).astype(np.uint64) if codes else np.empty(0, np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(flat))
    ids, owner = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, longest + 1):
        ok = at + n <= end
        nxt = np.minimum(at + n - 1, max(len(flat) - 1, 0))
        h = (h ^ flat[nxt]) * np.uint64(0x100000001B3) + np.uint64(n)
        g = h ^ (h >> np.uint64(29))
        g = g * np.uint64(0xBF58476D1CE4E5B9)
        ids.append((g >> np.uint64(48))[ok])
        owner.append(word[ok])
    owner_, ids_ = np.concatenate(owner), np.concatenate(ids)
    order = np.argsort(owner_, kind="stable")
    return ids_[order].astype(np.int64), np.bincount(owner_, minlength=len(words))


class Model:
    """Log-probabilities of n-gram buckets by language."""

    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.languages = languages
        total = counts.sum(1, keepdims=True)
        self.table = np.log((counts + smooth) / (total + smooth * counts.shape[1])).astype(np.float32).T.copy()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """words x languages: log-likelihood of each word."""
        if not words:
            return np.empty((0, len(self.languages)), np.float32)
        ids, n = gram_ids(words)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        sums = np.add.reduceat(self.table[ids], starts, axis=0)
        # An n-gram of each length starts at each letter: weigh them as about one observation a letter.
        return (sums / 4).astype(np.float32)


class WordTable:
    def __init__(self, model: Model, limit: int = 400_000):
        self._model, self._limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self._index: dict[str, int] = {}
        self._rows = np.empty((1024, len(self._model.languages)), np.float32)

    def rows(self, docs: list[Counter]) -> np.ndarray:
        """Scores of all words of the documents, one after another."""
        new = list({w for d in docs for w in d if w not in self._index})
        if len(self._index) + len(new) > self._limit:
            self._clear()
            new = list({w for d in docs for w in d})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            at = len(self._index)
            if at + len(part) > len(self._rows):
                grown = np.empty((max(2 * len(self._rows), at + len(part)), self._rows.shape[1]), np.float32)
                grown[:at] = self._rows[:at]
                self._rows = grown
            self._rows[at : at + len(part)] = self._model.word_scores(part)
            self._index.update(zip(part, range(at, at + len(part)), strict=True))
        get = self._index.__getitem__
        return self._rows[np.fromiter((get(w) for d in docs for w in d), np.int64, sum(map(len, docs)))]


def _of_active(scores: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words: likelihoods in the active languages as shares of the best of them, and the log of that best one.

    Nothing is cut off: a word that every language finds very unlikely keeps its log-likelihood.
    """
    shown = np.where(active, scores, -np.inf)
    top = shown.max(1)
    return np.exp(shown - top[:, None]), top


def _em(scores: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, active: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) over each document's active languages, and the log-likelihoods.

    ``scores``: words x languages, log-likelihoods.
    """
    total = np.add.reduceat(n, starts)
    pi = active / active.sum(1, keepdims=True)
    like, top = _of_active(scores, active[doc] > 0)
    for _ in range(rounds):
        joint = like * pi[doc]
        share = joint * (n / joint.sum(1))[:, None]
        pi = np.add.reduceat(share, starts, axis=0) / total[:, None]
    return pi, np.add.reduceat(n * (np.log((like * pi[doc]).sum(1)) + top), starts)


def infer(table: WordTable, docs: list[Counter], penalty: float = 4.0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Of documents with words: proportions (documents x languages) after the choice of the set, and the set."""
    scores = table.rows(docs).astype(np.float64)
    n = np.fromiter((c for d in docs for c in d.values()), np.float64, len(scores))
    sizes = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(docs)), sizes)
    scores -= scores.max(1, keepdims=True)
    total = np.add.reduceat(n, starts)
    languages = scores.shape[1]
    single = np.add.reduceat(n[:, None] * scores, starts, axis=0)
    best = single.argmax(1)
    active = np.zeros((len(docs), languages))
    active[np.arange(len(docs)), best] = 1.0
    ll = single[np.arange(len(docs)), best]
    pi = active.copy()
    open_ = np.arange(len(docs))
    for _ in range(languages - 1):
        if not len(open_):
            break
        # The candidate that gains most when it may take each word from the present mixture at an even split.
        sub = np.isin(doc, open_) if len(open_) < len(docs) else np.ones(len(doc), bool)
        renum = np.full(len(docs), -1)
        renum[open_] = np.arange(len(open_))
        d, s, m = renum[doc[sub]], scores[sub], n[sub]
        st = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
        like, top = _of_active(s, active[open_][d] > 0)
        now = np.log((like * pi[open_][d]).sum(1)) + top
        mixed = 0.8 * np.exp(now)[:, None] + 0.2 * np.exp(s)
        tiny = mixed < 1e-280  # both so far below the best language that only logs tell them apart
        gains = np.log(np.where(tiny, 1.0, mixed))
        if tiny.any():
            w, c = np.nonzero(tiny)
            gains[w, c] = np.logaddexp(np.log(0.8) + now[w], np.log(0.2) + s[w, c])
        gain = np.add.reduceat(m[:, None] * gains, st, axis=0)
        gain[active[open_] > 0] = -np.inf
        trial = active[open_].copy()
        trial[np.arange(len(open_)), gain.argmax(1)] = 1.0
        got, new_ll = _em(s, m, d, st, trial, rounds)
        take = 2 * (new_ll - ll[open_]) > penalty * np.log(total[open_] + 1)
        kept = open_[take]
        active[kept], pi[kept], ll[kept] = trial[take], got[take], new_ll[take]
        open_ = kept
    return pi, active


def _count_batches(languages: list[str]):
    """(lang, text) -> (lang index, bucket, n), combined per task."""
    at = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            bags: dict[int, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bags.setdefault(at[lang], Counter()).update(text_words(text))
            for i, bag in bags.items():
                words, n = list(bag), np.array(list(bag.values()), np.float64)
                for j in range(0, len(words), 50_000):
                    ids, per = gram_ids(words[j : j + 50_000])
                    counted = np.bincount(ids, np.repeat(n[j : j + 50_000], per), BUCKETS)
                    found[i] = found.get(i, 0) + counted
        for i, counts in found.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), i, np.int32)), pa.array(full.astype(np.int32)), pa.array(counts[full].astype(np.int64))], ["lang", "bucket", "n"])

    return run


def train(labelled: DataFrame, sample_per_language: int = 1500, most: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from documents with text and language.

    Of each language about ``sample_per_language`` documents are used, drawn by a hash of id and text (all, if there
    are fewer); this bounds the training cost. The model has 65,536 numbers for each language, so it learns the ``most``
    languages with the most labelled documents (of equals the first by name): a dirty column can't make it grow.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    rates = spark.createDataFrame([(lang, min(1.0, sample_per_language / sizes[lang])) for lang in languages], "lang string, rate double")
    draw = F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(rates), "lang").where(draw < F.col("rate"))  # ``most`` rows at most
    counted = chosen.select("lang", "text").mapInArrow(_count_batches(languages), "lang int, bucket int, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    counts[summed.column("lang").to_numpy(), summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return Model(languages, counts)


def _predict_batches(model_ref, penalty: float, added: list[str], cut_chars: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_ref.value
        table = WordTable(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores, sets = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            i = 0
            while i < len(texts):
                held, at, chars = [], [], 0
                while i < len(texts) and chars < cut_chars:
                    bag = text_words(texts[i])
                    chars += len(texts[i] or "")
                    if bag:
                        held.append(bag)
                        at.append(i)
                    i += 1
                if held and model.languages:
                    pi, active = infer(table, held, penalty)
                    best = pi.argmax(1)
                    for k, row in enumerate(at):
                        names[row], scores[row] = model.languages[best[k]], min(1.0, max(0.0, pi[k, best[k]]))
                        sets[row] = [model.languages[j] for j in np.flatnonzero(active[k])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names), pa.array(scores), pa.array(sets, pa.list_(pa.string()))], [*batch.schema.names[:-1], *added])

    return run


def predict(docs: DataFrame, model: Model, penalty: float = 4.0, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and lang_pred, score, lang_set (by other names, where ``docs`` has these).

    lang_pred is the language with the largest proportion and score that proportion; lang_set lists the chosen
    languages. Null texts and texts without a letter are ``und`` with score 0, and so is everything when nothing was
    learned. Other columns are ignored, whatever their names.
    """
    keep = keep if keep is not None else ["doc_id"]
    ref = docs.sparkSession.sparkContext.broadcast(model)
    text = common.unique_name(docs, "langid_text")
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text))
    names = [common.unique_name(docs, x) for x in ("lang_pred", "score", "lang_set")]
    kinds = (T.StringType(), T.DoubleType(), T.ArrayType(T.StringType()))
    schema = T.StructType([*src.schema.fields[:-1], *map(T.StructField, names, kinds)])
    return src.mapInArrow(_predict_batches(ref, penalty, names), schema)


def learned(docs: DataFrame, **options) -> Model:
    """The model from the rows of ``docs`` that are not held out (crc32 of the id mod 3 is not 1)."""
    return train(docs.where(common.crc_mod(F.col("doc_id"), 3) != 1), **options)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of the labelled ones."""
    docs = common.table(spark, sf_dir, "documents")
    out = predict(docs, learned(docs))
    return out.select("doc_id", (common.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
