"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, dart_minhash, language_id, license_scan, line_dedup, mixing, quality, sharding, stream_dedup, topk


def queries() -> dict:
    return {
        "op1_dart_minhash": dart_minhash.op1_dart_minhash,
        "op2_byte_shards": sharding.op2_byte_shards,
        "op3_fourier_quality": quality.op3_fourier_quality,
        "op4_word_bpe": bpe.op4_word_bpe,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_pfair_mixing": mixing.op6_pfair_mixing,
        "op7_crf_language_id": language_id.op7_crf_language_id,
        "op8_stream_dedup": stream_dedup.op8_stream_dedup,
        "op9_uniform_threshold_topk": topk.op9_uniform_threshold_topk,
        "op10_deletion_line_dedup": line_dedup.op10_deletion_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_license_scan": license_scan.oracle(),
        "op6_pfair_mixing": mixing.oracle(),
        "op8_stream_dedup": stream_dedup.oracle(),
        "op9_uniform_threshold_topk": topk.oracle(),
    }
