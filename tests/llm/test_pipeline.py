import zlib

import numpy as np
import pytest

import corpus_pipeline
from newsloom.llm import common, langid, packing
from tests.llm import test_decontaminate, test_minhash, test_mixing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    bench = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    columns = docs.columns
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = common.materialise(stage(spark, docs, SF), "test-stage")
        made[name] = docs.count()
        if name == "language_id":
            want = [r for r in before if any(c.isalpha() for c in r[1] or "")]
        elif name == "near_duplicates":
            least = {d: c for d, _, c in test_minhash.brute([r[:2] for r in before], 5, 80)}
            want = [r for r in before if least[r[0]] in (r[0], None)]
        elif name == "decontamination":
            flags = {r[0]: r[5] for r in test_decontaminate.brute([r[:2] for r in before], bench)}
            want = [r for r in before if not flags[r[0]]]
        if name == "mixing":
            size = lambda t: len((t or "").encode().split())
            sizes, taken = {}, {}
            for _, t, s in before:
                sizes[s] = sizes.get(s, 0) + size(t)
            rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
            assert set(rows) <= set(before)
            for _, t, s in rows:
                taken[s] = taken.get(s, 0) + size(t)
            for s, words in test_mixing.targets(sizes).items():
                mean = sizes[s] / max(1, sum(x == s for _, _, x in before))
                assert abs(taken.get(s, 0) - words) <= max(0.1 * words, 2 * mean)  # ten documents a source
        elif name != "token_packing":
            assert docs.columns == columns
            assert sorted((r.doc_id, r.text, r.source) for r in docs.collect()) == sorted(want)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(packing.tokenizer_path())
            crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
            assert sorted((r.doc_id, r.ids_crc32) for r in docs.collect()) == sorted((d, crc(t)) for d, t, _ in before)
    assert made["near_duplicates"] < made["language_id"]


def test_repeated_and_odd_rows(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (1, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (1, "Alpha beta  gamma delta epsilon zeta", "en", "s", 1),
            (2, "alpha beta gamma delta epsilon zeta", "en", "t", 1), (3, None, "en", "s", 0), (None, "one two", "en", None, 0), (4, "!!", None, "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    got = sorted(((r.doc_id, (r.text or "").lower().split()) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1].split()), (3, []), (None, ["one", "two"]), (4, ["!!"])], key=str)
    kept = corpus_pipeline.keep_languages(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "1", "2", "None"]


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0 and langid.Model([], np.zeros((0, 4))).languages == []


@pytest.mark.parametrize("name", ["op7_minhash", "pipeline"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()
