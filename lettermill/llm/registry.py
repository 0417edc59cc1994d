"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lettermill.llm import alignment, decontaminate, embedding_join, kneserney, langid, licenses, mixing, passages, quality, sharding, simhash, spelling, substrings

QUERIES = {
    "op1_shard_bytes": sharding.op1_shard_bytes,
    "op2_substrings": substrings.op2_substrings,
    "op3_passages": passages.op3_passages,
    "op4_embedding_join": embedding_join.op4_embedding_join,
    "op5_simhash": simhash.op5_simhash,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_langid": langid.op7_langid,
    "op8_licenses": licenses.op8_licenses,
    "op9_mix": mixing.op9_mix,
    "op10_kneserney": kneserney.op10_kneserney,
    "op11_alignment": alignment.op11_alignment,
    "op12_quality": quality.op12_quality,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {
    "op1_shard_bytes": sharding.SQL,
    "op2_substrings": substrings.SQL,
    "op3_passages": passages.SQL,
    "op4_embedding_join": embedding_join.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op9_mix": mixing.SQL,
    "op12_quality": quality.SQL,
    "op13_spelling": spelling.SQL,
}
