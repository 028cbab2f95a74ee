"""Queries of this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline
from inventa.llm import op1_bpe, op2_substrings, op3_warc, op4_quality, op5_backoff, op6_toxicity, op7_tiling, op8_tokens, op9_simhash, op10_html, oracles


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe.op1_bpe,
        "op2_substrings": op2_substrings.op2_substrings,
        "op3_warc": op3_warc.op3_warc,
        "op4_quality": op4_quality.op4_quality,
        "op5_backoff": op5_backoff.op5_backoff,
        "op6_toxicity": op6_toxicity.op6_toxicity,
        "op7_tiling": op7_tiling.op7_tiling,
        "op8_tokens": op8_tokens.op8_tokens,
        "op9_simhash": op9_simhash.op9_simhash,
        "op10_html": op10_html.op10_html,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op2_substrings": op2_substrings.SQL, "op3_warc": op3_warc.SQL, "op4_quality": oracles.OP4, "op5_backoff": op5_backoff.SQL, "op9_simhash": oracles.OP9, "op10_html": oracles.OP10}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
