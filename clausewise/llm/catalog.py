"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from clausewise.llm import ann, bitslice, collocations, htmltext, jaccard, langid, middle, mixing, passages, secrets, spm, surrogates, warc

QUERIES = {
    "op1_passages": passages.op1_passages,
    "op2_ann": ann.op2_ann,
    "op3_surrogates": surrogates.op3_surrogates,
    "op4_langid": langid.op4_langid,
    "op5_sentencepiece": spm.op5_sentencepiece,
    "op6_topk": bitslice.op6_topk,
    "op7_html": htmltext.op7_html,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_warc": warc.op9_warc,
    "op10_mixture": mixing.op10_mixture,
    "op11_middle": middle.op11_middle,
    "op12_collocations": collocations.op12_collocations,
    "op13_secrets": secrets.op13_secrets,
}

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op1_passages": passages.OP1_SQL,
    "op6_topk": bitslice.OP6_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_middle": middle.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
