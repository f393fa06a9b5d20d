"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, divergence, language_id, line_dedup, lm_score, quality_rules, repeats, resample, secret_scan, simhash, token_records, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_token_records": token_records.op4_token_records,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_simhash": simhash.op7_simhash,
    "op8_warc": warc.op8_warc,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_repeats": repeats.op10_repeats,
    "op11_resample": resample.op11_resample,
    "op12_divergence": divergence.op12_divergence,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}

SQL: dict[str, str] = {"op2_quality_rules": quality_rules.SQL, "op11_resample": resample.SQL, "op12_divergence": divergence.SQL, "op13_secret_scan": secret_scan.SQL}
