"""Queries of the corpus operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from fairlead.llm import decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, pii, quality, substring_dedup, token_store, url_filter


def queries():
    found = (decontaminate.op1_decontaminate, token_store.op2_token_store, line_dedup.op3_line_dedup, exact_dedup.op4_exact_dedup, substring_dedup.op5_substring_dedup, url_filter.op6_url_filter, jaccard_join.op7_jaccard_join, pii.op8_pii, mixing.op9_mixing, quality.op10_quality)
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op3_line_dedup": line_dedup.SQL, "op8_pii": pii.SQL, "op4_exact_dedup": exact_dedup.SQL, "op5_substring_dedup": substring_dedup.SQL, "op6_url_filter": url_filter.SQL}
