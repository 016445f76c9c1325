"""Queries of the training-data operators by name and their SQL twins."""

from __future__ import annotations

from skein.llm import automaton, classifier, html_text, lines, matroska, mixing, pipeline, quality_rules, runs, secrets, sharding, simhash, urls, whitening

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_media_columns": matroska.op2_media_columns,
    "op3_quality_score": classifier.op3_quality_score,
    "op4_decontaminate": automaton.op4_decontaminate,
    "op5_shard": sharding.op5_shard,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_html_text": html_text.op7_html_text,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_url_filter": urls.op9_url_filter,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_whiten": whitening.op12_whiten,
    "op13_quality_rules": quality_rules.op13_quality_rules,
    "pipeline": pipeline.run,
}
ORACLE = {"op1_mix_sources": mixing.ORACLE_OP1, "op4_decontaminate": automaton.ORACLE_OP4, "op5_shard": sharding.ORACLE_OP5, "op8_line_dedup": lines.ORACLE_OP8, "op9_url_filter": urls.ORACLE_OP9}
