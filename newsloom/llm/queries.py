"""The queries of this subpackage, one for each operator, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from newsloom.llm import ann, codes, decontaminate, langid, licenses, lm, minhash, mixing, packing, quality, setjoin, spelling, unigram


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm": lm.op1_lm,
        "op2_langid": langid.op2_langid,
        "op3_quality": quality.op3_quality,
        "op4_licenses": licenses.op4_licenses,
        "op5_ann": ann.op5_ann,
        "op6_token_counts": unigram.op6_token_counts,
        "op7_minhash": minhash.op7_minhash,
        "op8_mixing": mixing.op8_mixing,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_packing": packing.op10_packing,
        "op11_jaccard": setjoin.op11_jaccard,
        "op12_spelling": spelling.op12_spelling,
        "op13_codes": codes.op13_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_licenses": licenses.OP4_SQL,
        "op7_minhash": minhash.OP7_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op9_decontaminate": decontaminate.OP9_SQL,
        "op11_jaccard": setjoin.OP11_SQL,
        "op12_spelling": spelling.OP12_SQL,
        "op13_codes": codes.OP13_SQL,
    }
