"""Queries and SQL of this subpackage, as ``__spark_entry__`` adds them."""

from __future__ import annotations

from loamix.llm import decontaminate, embeddings, mixing, quality, simhash, substrings, token_output, toxicity, url_filter, warc

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_quality_resampling": quality.op3_quality_resampling,
    "op4_embedding_dedup": embeddings.op4_embedding_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_warc_round_trip": warc.op7_warc_round_trip,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_simhash_dedup": simhash.op9_simhash_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLES = {**substrings.ORACLE, **decontaminate.ORACLE, **embeddings.ORACLE, **url_filter.ORACLE, **warc.ORACLE}
