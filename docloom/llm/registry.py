"""The subpackage's queries and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from docloom.llm import decontamination, html_text, language_id, lattice_lm, lexical_search, line_dedup, near_dedup, packing, quality_rules, sharding, toxicity, url_filter, whitening


def queries() -> dict:
    """Query callables by name."""
    return {
        "pipeline": corpus_pipeline.run,
        "op1_template_windows": decontamination.op1_template_windows,
        "op2_char_ratio": url_filter.op2_char_ratio,
        "op3_subword_lattice": lattice_lm.op3_subword_lattice,
        "op4_nnls_patterns": packing.op4_nnls_patterns,
        "op5_crf_spans": toxicity.op5_crf_spans,
        "op6_threshold_rules": quality_rules.op6_threshold_rules,
        "op7_histogram_sort": sharding.op7_histogram_sort,
        "op8_simhash_bktree": near_dedup.op8_simhash_bktree,
        "op9_text_density": html_text.op9_text_density,
        "op10_levelled_runs": line_dedup.op10_levelled_runs,
        "op11_exact_whitening": whitening.op11_exact_whitening,
        "op12_geometric_blocks": lexical_search.op12_geometric_blocks,
        "op13_cross_parsing": language_id.op13_cross_parsing,
    }


def oracle_sql() -> dict:
    """DuckDB texts by name."""
    return {
        "op2_char_ratio": url_filter.OP2_SQL,
        "op6_threshold_rules": quality_rules.OP6_SQL,
        "op10_levelled_runs": line_dedup.OP10_SQL,
        "op12_geometric_blocks": lexical_search.OP12_SQL,
    }
