"""The queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, fill_in_middle, jaccard_join, language_id, line_dedup, periodic_runs, secret_scan, sentencepiece_codec, substring_dedup, suffix_dedup, token_output, toxicity
from .oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_language_id": language_id.op2_language_id,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_token_output": token_output.op6_token_output,
    "op7_nearest": ann.op7_nearest,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
