"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from quirefold.llm import bpe, credentials, fingerprint, forest, langid, mixing, omh, runs, sharding, suffixes, tokenfile, turns, warc

QUERIES = {
    "op1_secrets": credentials.op1_secrets,
    "op2_langid": langid.op2_langid,
    "op3_tokens": tokenfile.op3_tokens,
    "op4_bpe": bpe.op4_bpe,
    "op5_warc": warc.op5_warc,
    "op6_near_dedup": omh.op6_near_dedup,
    "op7_embeddings": forest.op7_embeddings,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_mixing": mixing.op9_mixing,
    "op10_sharding": sharding.op10_sharding,
    "op11_suffix_dedup": suffixes.op11_suffix_dedup,
    "op12_turn_repair": turns.op12_turn_repair,
    "op13_runs": runs.op13_runs,
}
SQL = {"op5_warc": warc.SQL_OP5, "op7_embeddings": forest.SQL_OP7, "op11_suffix_dedup": suffixes.SQL_OP11, "op13_runs": runs.SQL_OP13}
