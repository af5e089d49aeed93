import random

import pyarrow.dataset as ds
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from newsloom.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string"


def library(vocab):
    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], unk_id=0))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")])
    return tokenizer


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_small_vocabularies_with_ties(seed):
    rng = random.Random(seed)
    pieces = {"▁"} | {"".join(rng.choice("abc▁"[: 3 + (i == 0)]) for i in range(rng.randint(1, 4))) for _ in range(25)}
    vocab = [(p, float(-rng.randint(1, 4))) for p in sorted(pieces) if "▁" not in p[1:]]
    tokenizer, counter = library(vocab), unigram.PieceCounter(vocab)
    for _ in range(400):
        text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 5)))
        assert counter.text(text)[0] == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_public_pieces_on_documents():
    vocab = unigram.vocabulary(PATH)
    assert all("▁" not in p[1:] for p, _ in vocab)
    tokenizer, counter = library(vocab), unigram.PieceCounter(vocab, limit=2000)
    texts = [t for t in ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table()["text"].to_pylist() if t]
    texts += ["日本語 \x1cq \x85 x ∀∃∄ ∀ \U0001f600\U0001f601 a▁b", "é" * 50, "x" * 5000]
    for text in texts:
        assert counter.text(text)[0] == len(tokenizer.encode(text, add_special_tokens=False).ids), text[:80]


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, " \n\t", "x"), (2, "the the", "x"), (2, "the the", "x"), (3, "word " * 30000, "x")]
    tokenizer = library(unigram.vocabulary(PATH))
    the, one = (len(tokenizer.encode(w, add_special_tokens=False).ids) for w in ("the", "word"))
    got = unigram.token_counts(spark.createDataFrame(rows, SCHEMA), PATH)
    assert got.columns == ["doc_id", "n_tokens", "best_score"]
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == [("1", 0), ("1", 0), ("2", 2 * the), ("2", 2 * the), ("3", 30000 * one), ("None", 0)]
    assert unigram.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0
