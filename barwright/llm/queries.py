"""The numbered queries of this subpackage and, where SQL can say it, the same for DuckDB."""

from __future__ import annotations

from . import embedding_dups, exact_dups, fill_middle, jaccard, langid, mixing, packing, secrets, substring, token_align, token_files, topk, toxicity

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_language_id": langid.op3_language_id,
    "op4_token_files": token_files.op4_token_files,
    "op5_embedding_near_dedup": embedding_dups.op5_embedding_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_ngram_jaccard_join": jaccard.op7_ngram_jaccard_join,
    "op8_exact_top_k": topk.op8_exact_top_k,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_exact_dedup": exact_dups.op12_exact_dedup,
    "op13_cross_tokenizer": token_align.op13_cross_tokenizer,
}
ORACLES = {
    "op5_embedding_near_dedup": embedding_dups.OP5_SQL,
    "op8_exact_top_k": topk.OP8_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op12_exact_dedup": exact_dups.OP12_SQL,
}
