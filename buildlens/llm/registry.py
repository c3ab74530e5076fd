"""The corpus operators' queries, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import audio, mixing, near_dedup, packing, passages, pii, quality_cnn, quality_rules, secret_scan, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_packing": packing.op2_packing,
    "op3_warc": warc.op3_warc,
    "op4_pii": pii.op4_pii,
    "op5_passages": passages.op5_passages,
    "op6_mixing": mixing.op6_mixing,
    "op7_audio": audio.op7_audio,
    "op8_quality_cnn": quality_cnn.op8_quality_cnn,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}
ORACLES = {"op1_near_dedup": near_dedup.oracle(), "op3_warc": warc.oracle(), "op6_mixing": mixing.oracle(), "op10_secret_scan": secret_scan.oracle()}
