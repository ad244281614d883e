"""The subpackage's queries and their SQL, as (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from lectern.llm import bpe, decontaminate, language_id, license_scan, line_dedup, near_dedup, quality_rules, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_language_id": language_id.op8_language_id,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_bpe": bpe.op10_bpe,
}

#: Operators that SQL can express; the others are tested against brute force.
ORACLE_SQL = {
    "op1_url_filter": url_filter.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
}
