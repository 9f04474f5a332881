"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from catchment.llm import bloom_cascade, collocations, decontaminate, exact_index, fill_middle, jaccard_join, langid, license_join, line_chunks, packing, quality, sharding, token_planes

QUERIES = {
    "op1_exact_dedup": exact_index.op1_exact_dedup,
    "op2_token_planes": token_planes.op2_token_planes,
    "op3_license_join": license_join.op3_license_join,
    "op4_line_chunks": line_chunks.op4_line_chunks,
    "op5_benchmark_leaks": decontaminate.op5_benchmark_leaks,
    "op6_url_cascade": bloom_cascade.op6_url_cascade,
    "op7_packed_sequences": packing.op7_packed_sequences,
    "op8_byte_shards": sharding.op8_byte_shards,
    "op9_language_mixture": langid.op9_language_mixture,
    "op10_jaccard_components": jaccard_join.op10_jaccard_components,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_quality_rules": quality.op12_quality_rules,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op1_exact_dedup": exact_index.SQL,
    "op3_license_join": license_join.SQL,
    "op6_url_cascade": bloom_cascade.SQL,
    "op8_byte_shards": sharding.SQL,
    "op11_fill_middle": fill_middle.SQL,
    "op13_collocations": collocations.SQL,
}
