"""The queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnframe.llm import bpe, embeddings, fingerprint, language, line_dedup, packing, pii, secrets, simhash, suffix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embeddings": embeddings.op1_embeddings,
        "op2_simhash": simhash.op2_simhash,
        "op3_language": language.op3_language,
        "op4_pii": pii.op4_pii,
        "op5_secrets": secrets.op5_secrets,
        "op6_fingerprint": fingerprint.op6_fingerprint,
        "op7_packing": packing.op7_packing,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_repeats": suffix.op9_repeats,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """SQL can express these; the others are held against brute force in tests/llm."""
    return {"op1_embeddings": embeddings.OP1_SQL, "op10_line_dedup": line_dedup.OP10_SQL}
