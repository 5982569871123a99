"""The registered queries of this subpackage."""

from __future__ import annotations

from twinlake.llm import ann, bagminhash, bpe, collocations, filter_audit, langid, linededup, maxent_lm, media, packing, pii, sharding, token_store


def queries() -> dict:
    return {
        "op1_image_copies": media.op1,
        "op2_bit_planes": token_store.op2,
        "op3_language": langid.op3,
        "op4_packing": packing.op4,
        "op5_bpe": bpe.op5,
        "op6_maxent_lm": maxent_lm.op6,
        "op7_line_dedup": linededup.op7,
        "op8_pii": pii.op8,
        "op9_near_duplicates": bagminhash.op9,
        "op10_nearest": ann.op10,
        "op11_collocations": collocations.op11,
        "op12_shards": sharding.op12,
        "op13_filter_audit": filter_audit.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": linededup.OP7_SQL, "op11_collocations": collocations.OP11_SQL, "op12_shards": sharding.OP12_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
