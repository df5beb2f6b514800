"""The queries of this subpackage and the SQL that some of them are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_minhash, op2_toxicity, op3_urls, op4_nearest, op5_mixing, op6_bpe, op7_exact, op8_suffixes, op9_counts, op10_lines, op11_alignment, op12_licenses, op13_divergence


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash.query,
        "op2_toxicity": op2_toxicity.query,
        "op3_url_filter": op3_urls.query,
        "op4_nearest": op4_nearest.query,
        "op5_mixing": op5_mixing.query,
        "op6_bpe": op6_bpe.query,
        "op7_exact_dedup": op7_exact.query,
        "op8_suffix_dedup": op8_suffixes.query,
        "op9_token_counts": op9_counts.query,
        "op10_line_dedup": op10_lines.query,
        "op11_tokenizer_alignment": op11_alignment.query,
        "op12_license_scan": op12_licenses.query,
        "op13_source_divergence": op13_divergence.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": op7_exact.SQL, "op12_license_scan": op12_licenses.SQL, "op13_source_divergence": op13_divergence.SQL}
