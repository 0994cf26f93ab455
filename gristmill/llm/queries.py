"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe, chat_format, decontaminate, fim, language_model, line_dedup, mixing, pii, quality_model, quality_rules, simhash, sketch, tandem

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality_classifier": quality_model.op3_quality_classifier,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_language_model": language_model.op5_language_model,
    "op6_bpe": bpe.op6_bpe,
    "op7_fingerprints": sketch.op7_fingerprints,
    "op8_chat_formatting": chat_format.op8_chat_formatting,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_pii": pii.op10_pii,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_periodic_runs": tandem.op12_periodic_runs,
    "op13_decontamination": decontaminate.op13_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op8_chat_formatting": chat_format.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op11_fill_in_middle": fim.ORACLE_SQL,
    "op13_decontamination": decontaminate.ORACLE_SQL,
}
