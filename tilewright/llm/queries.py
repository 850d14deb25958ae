"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import byte_bpe, chat_format, decontaminate, fingerprint, lm_score, near_dedup, quality, secrets, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": lm_score.op1_lm_score,
        "op2_fingerprint": fingerprint.op2_fingerprint,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_quality": quality.op4_quality,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": chat_format.ORACLE_SQL, "op10_decontaminate": decontaminate.ORACLE_SQL}
