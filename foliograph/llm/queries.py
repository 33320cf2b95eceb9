"""The queries of this subpackage and, where SQL can express one, its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from foliograph.llm import ann_forest, fill_in_middle, fingerprint, hmm_lm, jaccard_join, lexical_search, license_scan, line_dedup, mixing, piece_codec, secret_scan, tensor_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprint": fingerprint.op1_fingerprint,
        "op2_ann_forest": ann_forest.op2_ann_forest,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_hmm_lm": hmm_lm.op5_hmm_lm,
        "op6_mixing": mixing.op6_mixing,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_piece_codec": piece_codec.op10_piece_codec,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_tensor_dedup": tensor_dedup.op12_tensor_dedup,
        "op13_lexical_search": lexical_search.op13_lexical_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": license_scan.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op9_jaccard_join": jaccard_join.ORACLE,
        "op11_fill_in_middle": fill_in_middle.ORACLE,
        "op12_tensor_dedup": tensor_dedup.ORACLE,
        "op13_lexical_search": lexical_search.ORACLE,
        **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    }
