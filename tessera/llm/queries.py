"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, fingerprint, jaccard_join, merkle, mixing, packing, point_in_time, quality, secrets, sharding, substring_dedup, suffix_dedup, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_fingerprint": fingerprint.op4_fingerprint,
        "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
        "op6_packing": packing.op6_packing,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_secrets": secrets.op8_secrets,
        "op9_quality": quality.op9_quality,
        "op10_sharding": sharding.op10_sharding,
        "op11_point_in_time": point_in_time.op11_point_in_time,
        "op12_merkle": merkle.op12_merkle,
        "op13_token_files": token_files.op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.OP1_SQL,
        "op2_suffix_dedup": suffix_dedup.OP2_SQL,
        "op5_embedding_dedup": embedding_dedup.OP5_SQL,
        "op7_jaccard_join": jaccard_join.OP7_SQL,
        "op10_sharding": sharding.OP10_SQL,
        "op11_point_in_time": point_in_time.OP11_SQL,
        "op12_merkle": merkle.OP12_SQL,
    }
