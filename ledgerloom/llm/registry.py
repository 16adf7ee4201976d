"""The queries of this package and their SQL."""

from __future__ import annotations

from . import decontaminate, licenses, neardup, ngram_lm, packing, quality, repeats, secrets, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_warc_chunks": warc.op2_warc_chunks,
    "op3_bloom_lm": ngram_lm.op3_bloom_lm,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_trigram_secrets": secrets.op5_trigram_secrets,
    "op6_chosen_path_neardup": neardup.op6_chosen_path_neardup,
    "op7_nnpu_toxicity": toxicity.op7_nnpu_toxicity,
    "op8_license_tfidf": licenses.op8_license_tfidf,
    "op9_kneser_ney_quality": quality.op9_kneser_ney_quality,
    "op10_recompression_dedup": repeats.op10_recompression_dedup,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_warc_chunks": warc.OP2_SQL,
    "op5_trigram_secrets": secrets.OP5_SQL,
    "op6_chosen_path_neardup": neardup.OP6_SQL,
    "op8_license_tfidf": licenses.OP8_SQL,
    "op10_recompression_dedup": repeats.OP10_SQL,
}
