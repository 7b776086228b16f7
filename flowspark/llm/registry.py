"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, jaccard, licenses, lines, merkle, mixing, packing, quality, resample, spans, topk, urls, warc

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_url_filters": urls.op7_url_filters,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_warc": warc.op9_warc,
    "op10_substring_dedup": spans.op10_substring_dedup,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_byte_bpe": bpe.op12_byte_bpe,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op1_source_mixing": mixing.OP1_SQL,
    "op2_line_dedup": lines.OP2_SQL,
    "op4_ngram_jaccard": jaccard.OP4_SQL,
    "op5_exact_topk": topk.OP5_SQL,
    "op7_url_filters": urls.OP7_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_importance_resampling": resample.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
