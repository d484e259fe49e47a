"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from archivolt.llm import ann, bpe, filters, langid, licenses, mpeg, packing, sharding, simhash, spelling, substring, topk, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_packing": packing.op2_packing,
    "op3_exact_topk": topk.op3_exact_topk,
    "op4_ann": ann.op4_ann,
    "op5_licenses": licenses.op5_licenses,
    "license_base": licenses.license_base,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_langid": langid.op8_langid,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash": simhash.op10_simhash,
    "op11_mpeg_audio": mpeg.op11_mpeg_audio,
    "op12_filter_audit": filters.op12_filter_audit,
    "op13_spelling": spelling.op13_spelling,
}

SQL = {"op3_exact_topk": topk.OP3_SQL, "op6_substring_dedup": substring.OP6_SQL, "op12_filter_audit": filters.OP12_SQL, "license_base": licenses.BASE_SQL}
