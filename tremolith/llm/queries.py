"""The queries of this subpackage and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fill_in_middle, html_extract, license_scan, line_dedup, merkle_manifest, ngram_join, quality, sentence_pieces, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_sentence_pieces": sentence_pieces.op2_sentence_pieces,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality": quality.op10_quality,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op5_benchmark_decontamination": decontaminate.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_merkle_manifest": merkle_manifest.ORACLE,
}
