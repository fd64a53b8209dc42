"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from factloom.llm import chat, harmonic, jaccard, langid, maxent, media, mixing, packing, phrases, quality, sharding, spelling, topk


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_topk": topk.op2_topk,
        "op3_quality": quality.op3_quality,
        "op4_media": media.op4_media,
        "op5_mixing": mixing.op5_mixing,
        "op6_lm": maxent.op6_lm,
        "op7_langid": langid.op7_langid,
        "op8_chat": chat.op8_chat,
        "op9_packing": packing.op9_packing,
        "op10_jaccard": jaccard.op10_jaccard,
        "op11_phrases": phrases.op11_phrases,
        "op12_harmonic": harmonic.op12_harmonic,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.OP2_SQL, "op5_mixing": mixing.OP5_SQL, "op8_chat": chat.OP8_SQL, "op10_jaccard": jaccard.OP10_SQL, "op11_phrases": phrases.OP11_SQL}
