"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from facetmill.llm import jaccard, media, mixing, pii, sentencepiece, shards, suffixes, toxicity, urls, vptree


def queries() -> dict:
    return {"op1_nearest": vptree.op1_nearest, "op2_suffix_dedup": suffixes.op2_suffix_dedup, "op3_toxicity": toxicity.op3_toxicity, "op4_jaccard_join": jaccard.op4_jaccard_join, "op5_url_filter": urls.op5_url_filter, "op6_mixing": mixing.op6_mixing, "op7_sharding": shards.op7_sharding, "op8_media": media.op8_media, "op9_sentencepiece": sentencepiece.op9_sentencepiece, "op10_pii": pii.op10_pii}


def oracle_sql() -> dict:
    return {"op4_jaccard_join": jaccard.ORACLE_SQL, "op6_mixing": mixing.ORACLE_SQL}
