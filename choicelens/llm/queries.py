"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, lexical_search, manifest, mixing, near_duplicates, neighbours, quality, secrets, sharding, substrings, token_counts, token_output, url_filters

QUERIES = {
    "op1_nearest": neighbours.query,
    "op2_shard_placement": sharding.query,
    "op3_quality": quality.query,
    "op4_url_filter": url_filters.query,
    "op5_near_duplicates": near_duplicates.query,
    "op6_source_mix": mixing.query,
    "op7_secret_scan": secrets.query,
    "op8_decontamination": decontamination.query,
    "op9_token_output": token_output.query,
    "op10_token_counts": token_counts.query,
    "op11_substring_dedup": substrings.query,
    "op12_manifest": manifest.query,
    "op13_lexical_search": lexical_search.query,
}
ORACLES = {
    "op2_shard_placement": sharding.oracle(),
    "op11_substring_dedup": substrings.oracle(),
    "op12_manifest": manifest.oracle(),
    "op13_lexical_search": lexical_search.oracle(),
}
