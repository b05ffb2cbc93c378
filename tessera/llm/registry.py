"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import html_text, language, mixing, neighbours, packing, quality_model, quality_rules, simhash, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        warc.op1_warc,
        quality_rules.op2_quality_rules,
        quality_model.op3_quality_classifier,
        tokens.op4_token_counts,
        packing.op5_best_fit_packing,
        language.op6_language_id,
        neighbours.op7_nearest_neighbours,
        html_text.op8_html_extraction,
        mixing.op9_mixing,
        simhash.op10_simhash_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_warc": warc.OP1_SQL, "op2_quality_rules": quality_rules.OP2_SQL, "op9_mixing": mixing.OP9_SQL}
