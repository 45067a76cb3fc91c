"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from tripforge.llm import ctw, decontaminate, exact_dedup, html_extract, langid, mixing, near_join, pii, repeats, toxicity, trie, veccode, warc

QUERIES = {
    "op1_near_join": near_join.op1_near_join,
    "op2_ctw": ctw.op2_ctw,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_mixing": mixing.op6_mixing,
    "op7_repeats": repeats.op7_repeats,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_langid": langid.op10_langid,
    "op11_pii": pii.op11_pii,
    "op12_trie": trie.op12_trie,
    "op13_veccode": veccode.op13_veccode,
}
ORACLES = {
    "op4_decontaminate": decontaminate.ORACLE,
    "op5_warc": warc.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op12_trie": trie.ORACLE,
    "op13_veccode": veccode.ORACLE,
}
