"""Registry of the corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from deliverix.llm import ans, bpe, fill_in_middle, fingerprints, lexical, licenses, near_dup, neighbours, packing, quality, token_counts, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_licenses": licenses.op2_licenses,
        "op3_bpe": bpe.op3_bpe,
        "op4_near_dup": near_dup.op4_near_dup,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_quality": quality.op6_quality,
        "op7_packing": packing.op7_packing,
        "op8_ids": ans.op8_ids,
        "op9_nearest": neighbours.op9_nearest,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_lexical": lexical.op11_lexical,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_token_counts": token_counts.op13_token_counts,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE_SQL, "op4_near_dup": near_dup.ORACLE_SQL, "op11_lexical": lexical.ORACLE_SQL, "op12_fill_in_middle": fill_in_middle.ORACLE_SQL}
