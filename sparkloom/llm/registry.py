"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, line_dedup, lm_scoring, near_dedup, packing, periodic_runs, quality_rules, revisits, spelling, suffix_dedup, token_counts, toxicity, url_filters

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_revisits": revisits.op8_revisits,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_toxicity": toxicity.op13_toxicity,
}
SQL = {
    "op4_decontamination": decontamination.SQL,
    "op6_url_filters": url_filters.SQL,
    "op8_revisits": revisits.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_periodic_runs": periodic_runs.SQL,
}
