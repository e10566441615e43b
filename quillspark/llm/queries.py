"""The text operators' queries by name, and the SQL that checks them."""

from . import bpe, clustering, decontam, jaccard, langid, lexical, licenses, quality, sharding, simhash, substrings, topk, warc

QUERIES = {
    "op1_importance_resampling": quality.op1_importance_resampling,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_bounded_ring": sharding.op6_bounded_ring,
    "op7_language_id": langid.op7_language_id,
    "op8_warc": warc.op8_warc,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op9_ngram_jaccard_links": jaccard.op9_ngram_jaccard_links,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_centroid_clustering": clustering.op11_centroid_clustering,
    "op12_simhash": simhash.op12_simhash,
    "op13_lexical_search": lexical.op13_lexical_search,
    # parts of results, for their SQL
    "op2_byte_bpe_decoded": bpe.op2_byte_bpe_decoded,
    "op3_license_scan_base": licenses.op3_license_scan_base,
}
ORACLES = {
    "op2_byte_bpe_decoded": bpe.ORACLE_DECODED,
    "op3_license_scan_base": licenses.ORACLE_BASE,
    "op5_substring_dedup": substrings.ORACLE,
    "op6_bounded_ring": sharding.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_ngram_jaccard_join": jaccard.ORACLE,
    "op10_exact_topk": topk.ORACLE,
    "op11_centroid_clustering": clustering.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
