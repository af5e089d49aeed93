import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import packing

SCHEMA = "doc_id long, text string, ids string, shard int"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=70), max_size=12))
def test_shard_round_trip(bits, docs):
    docs = [[x & ((1 << bits) - 1) for x in d] for d in docs]
    ids = np.array([x for d in docs for x in d], np.uint32)
    data = b"".join(packing.encode_shard([i if i % 3 else None for i in range(len(docs))], np.array([len(d) for d in docs], np.int64), ids, bits, block=16))
    f = packing.ShardFile(io.BytesIO(data))
    assert f.ids == len(ids) and [f.document(i).tolist() for i in range(f.documents)] == docs
    a, b = sorted(random.Random(len(ids)).choices(range(len(ids) + 1), k=2))
    assert f.read(a, b).tolist() == ids[a:b].tolist()
    assert len(data) <= 44 + 17 * len(docs) + 8 * (-(-len(ids) // 16) + 1) + -(-len(ids) * bits // 8)


def test_width():
    assert [packing.width(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def texts():
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["Hello", "don't", "ÉCOLE,", "x y", "12,000", "áb", "<|endoftext|>", "日本語", "\x1cq", "İı", "ΣΑΣ"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rng.shuffle(rows)
    return rows + [(None, "no id"), (1000, None), (1001, ""), (1002, " \t\n"), (5, "five again"), (5, "and again"), (1003, "long " * 30000)]


@pytest.mark.parametrize("by_chunk,file_ids", [(True, 1 << 25), (False, 500)])
def test_round_trip_equals_the_library(spark, tmp_path, by_chunk, file_ids):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    df = spark.createDataFrame([(*r, "clash", 1) for r in texts()], SCHEMA)
    want = {}
    for doc_id, text in texts():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    rows = packing.tokens_round_trip(df, packing.tokenizer_path(), by_chunk=by_chunk, shards=5, file_ids=file_ids).collect()
    got, at = {}, 0
    rows.sort(key=lambda r: r.start)
    order = [r.doc_id for r in rows]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_table(spark):
    assert packing.tokens_round_trip(spark.createDataFrame([], SCHEMA), packing.tokenizer_path()).count() == 0


def test_chunks_equal_whole_texts():
    import pyarrow.dataset as ds
    from tokenizers import Tokenizer

    texts = [t for t in ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["text"])["text"].to_pylist() if t][:400]
    texts += ["Don't 'S it's L'ÉTÉ, naïve... ÿ Ÿ ß ẞ ª º ×÷ a.b, (x). 12th 5,000!? é É̂ x y z q <|endoftext|>, a<|startoftext|>b " + "Ab" * 50, "\x85 \x1c İSTANBUL ΣΑΣ"]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    encoder = packing.Encoder(packing.tokenizer_path(), True, 1, limit=3000)
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, encoder.dtype)[:-1].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_only_a_fitting_tokenizer_goes_by_chunks():
    words, whole = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    assert packing.splits_at_white_space(words) and not packing.splits_at_white_space(whole)
    with pytest.raises(ValueError):
        packing.Encoder(whole, True, 1)
    from tokenizers import Tokenizer

    text = "Two  words,\nand MORE: don't\t99 Élan "
    for path in (words, whole):
        got = packing.Encoder(path, None, 1)
        assert np.frombuffer(got.encode([text])[0], got.dtype).tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]
