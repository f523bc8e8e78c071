"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import exact_dedup, html_extract, language_id, lexical_search, line_crf, line_dedup, mixing, near_dedup, packing, quality_rules, secrets, spelling, vector_search


def queries() -> dict:
    return {
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op3_language_id": language_id.op3_language_id,
        "op8_quality_classifier": line_crf.op8_quality_classifier,
        "op9_html_extraction": html_extract.op9_html_extraction,
        "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_nearest_neighbours": vector_search.op11_nearest_neighbours,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_ranked_search": lexical_search.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": line_dedup.ORACLE,
        "op5_mix_sources": mixing.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
        "op11_nearest_neighbours": vector_search.ORACLE,
        "op12_spelling_variants": spelling.ORACLE,
        "op13_ranked_search": lexical_search.ORACLE,
    }
