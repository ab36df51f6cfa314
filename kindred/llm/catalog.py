"""The registered corpus queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from kindred.llm import chat, licenses, media, minhash, mixing, packing, quality, sharding, syncmers, warc
from kindred.llm.common import Query
from kindred.session import shipped


def queries() -> dict[str, Query]:
    found = {
        "op1_chat_link": chat.op1_chat_link,
        "op2_near_dedup": minhash.op2_near_dedup,
        "op3_pack": packing.op3_pack,
        "op4_minimax_shards": sharding.op4_minimax_shards,
        "op5_media": media.op5_media,
        "op6_syncmers": syncmers.op6_syncmers,
        "op7_mix": mixing.op7_mix,
        "op8_warc": warc.op8_warc,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_ordinal_quality": quality.op10_ordinal_quality,
    }
    return {name: shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_link": chat.OP1_SQL, "op7_mix": mixing.OP7_SQL, "op8_warc": warc.OP8_SQL}
