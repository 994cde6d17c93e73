"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from terralith.llm.language_id import op9_language_id
from terralith.llm.ngram_join import op5_ngram_jaccard_join
from terralith.llm.quality_net import op10_quality_net
from terralith.llm.ring_shards import op1_ring_shards
from terralith.llm.source_mix import op4_source_mix
from terralith.llm.sql import ORACLES
from terralith.llm.spot_signatures import op6_spot_signatures
from terralith.llm.substring_dedup import op2_seed_extend_dedup
from terralith.llm.suffix_dedup import op3_suffix_array_dedup
from terralith.llm.tiling import op8_string_tiling
from terralith.llm.url_filter import op7_url_filter

QUERIES = (
    op1_ring_shards,
    op2_seed_extend_dedup,
    op3_suffix_array_dedup,
    op4_source_mix,
    op5_ngram_jaccard_join,
    op6_spot_signatures,
    op7_url_filter,
    op8_string_tiling,
    op9_language_id,
    op10_quality_net,
)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
