"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, exact_dedup, html_text, language, line_dedup, lm_scoring, mixing, ngram_join, packing, quality, resampling, suffix_dedup, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_warc": warc.op5_warc,
    "op6_packing": packing.op6_packing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op7_line_runs": line_dedup.op7_line_runs,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_html_text": html_text.op9_html_text,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_language_id": language.op12_language_id,
    "op13_target_resampling": resampling.op13_target_resampling,
}
ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op5_warc": warc.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op7_line_runs": line_dedup.RUNS_ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
}
