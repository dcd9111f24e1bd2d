"""Queries of the training-data operators, by registered name."""

from __future__ import annotations

import corpus_pipeline

from . import counts, covertree, lexical, lines, minhash, mixing, pieces, pii, quality, simhash, toxicity, variants, warc

QUERIES = {
    "op8_mixing": mixing.op8_mixing,
    "op1_warc": warc.op1_warc,
    "op3_covertree": covertree.op3_covertree,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_token_counts": counts.op6_token_counts,
    "op7_pii": pii.op7_pii,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_simhash": simhash.op10_simhash,
    "op11_lexical": lexical.op11_lexical,
    "op12_minhash": minhash.op12_minhash,
    "op13_variants": variants.op13_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op3_covertree": covertree.OP3_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_lexical": lexical.OP11_SQL,
    "op12_minhash": minhash.OP12_SQL,
    "op13_variants": variants.OP13_SQL,
}
