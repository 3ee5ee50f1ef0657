"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from tidewatch.llm import bpe, collocations, hilbert, kd_tree, languages, merkle, mixing, near_duplicates, page_text, quality, surrogates, token_counts, warc

QUERIES = {
    "op1_warc_seekable": warc.op1_warc_seekable,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_quality": quality.op3_quality,
    "op4_near_duplicates": near_duplicates.op4_near_duplicates,
    "op5_exact_top_k": kd_tree.op5_exact_top_k,
    "op6_approximate_neighbours": hilbert.op6_approximate_neighbours,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_surrogates": surrogates.op8_surrogates,
    "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
    "op10_page_text": page_text.op10_page_text,
    "op11_language_id": languages.op11_language_id,
    "op12_collocations": collocations.op12_collocations,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_seekable": warc.OP1_SQL,
    "op2_source_mixing": mixing.OP2_SQL,
    "op5_exact_top_k": kd_tree.OP5_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
