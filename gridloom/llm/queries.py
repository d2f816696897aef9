"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import edits, jaccard, lines, negatives, packing, quality, repairs, secrets, sentences, suffixes, toxicity, urls, vectors

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_secret_scans": secrets.op2,
    "op3_line_dedup": lines.op3,
    "op4_sentencepiece": sentences.op4,
    "op5_url_filters": urls.op5,
    "op6_ngram_jaccard_join": jaccard.op6,
    "op7_quality_rules": quality.op7,
    "op8_document_fingerprints": edits.op8,
    "op9_toxicity": toxicity.op9,
    "op10_suffix_array_dedup": suffixes.op10,
    "op11_vector_packing": vectors.op11,
    "op12_conversation_repair": repairs.op12,
    "op13_hard_negatives": negatives.op13,
}
ORACLE_SQL = {
    "op3_line_dedup": lines.OP3_SQL,
}
