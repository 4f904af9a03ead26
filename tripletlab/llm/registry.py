"""Queries of the training-data operators and the SQL of those that have it."""

from __future__ import annotations

from tripletlab.llm import bagminhash, bpe, covertree, exact, fmindex, packing, quality, sanitise, shard, warc

QUERIES = {
    "op1_bagminhash": bagminhash.op1_bagminhash,
    "op2_cover_tree": covertree.op2_cover_tree,
    "op3_bpe": bpe.op3_bpe,
    "op4_sanitise": sanitise.op4_sanitise,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_kd_shards": shard.op6_kd_shards,
    "op7_bayes_quality": quality.op7_bayes_quality,
    "op8_warc": warc.op8_warc,
    "op9_fm_substrings": fmindex.op9_fm_substrings,
    "op10_packing": packing.op10_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op2_cover_tree": covertree.ORACLE,
    "op5_exact_dedup": exact.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_fm_substrings": fmindex.ORACLE,
}
