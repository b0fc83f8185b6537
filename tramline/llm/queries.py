"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import audit, byte_bpe, exact_dedup, line_dedup, nearest, packing, quality, randomness, sharding, simhash, surrogates, whitening, wrapper

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_surrogates": surrogates.op6_surrogates,
    "op7_packing": packing.op7_packing,
    "op8_wrapper": wrapper.op8_wrapper,
    "op9_nearest": nearest.op9_nearest,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_whitening": whitening.op11_whitening,
    "op12_randomness": randomness.op12_randomness,
    "op13_audit": audit.op13_audit,
}

ORACLE_SQL = {**line_dedup.SQL, **exact_dedup.SQL, **randomness.SQL, **audit.SQL}
