"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, audit, bpe, chat, decontaminate, infill, neardup, ngrams, passages, pii, quality, sharding, sql, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_decontamination": decontaminate.op1_suffix_array_decontamination,
        "op2_content_defined_bpe": bpe.op2_content_defined_bpe,
        "op3_minhash_star_components": neardup.op3_minhash_star_components,
        "op4_role_repair": chat.op4_role_repair,
        "op5_crf_personal_data": pii.op5_crf_personal_data,
        "op6_anisotropic_neighbours": ann.op6_anisotropic_neighbours,
        "op7_prefix_sum_sharding": sharding.op7_prefix_sum_sharding,
        "op8_collinear_passages": passages.op8_collinear_passages,
        "op9_counterfactual_toxicity": toxicity.op9_counterfactual_toxicity,
        "op10_boosted_quality": quality.op10_boosted_quality,
        "op11_filter_interactions": audit.op11_filter_interactions,
        "op12_fill_in_middle": infill.op12_fill_in_middle,
        "op13_elias_fano_lm": ngrams.op13_elias_fano_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_decontamination": decontaminate.ORACLE_OP1,
        "op3_minhash_star_components": sql.OP3,
        "op7_prefix_sum_sharding": sql.OP7,
        "op11_filter_interactions": audit.ORACLE_OP11,
        "op12_fill_in_middle": infill.ORACLE_OP12,
    }
