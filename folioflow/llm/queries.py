"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import cube_mixing, feistel_sharding, kn_quality, lattice_lm, line_dedup, quality_rules, sketch_dedup, template_decontam, token_output, url_filter

QUERIES = {
    "op1_token_output": token_output.op1,
    "op2_kn_quality": kn_quality.op2,
    "op3_line_dedup": line_dedup.op3,
    "op4_cube_mixing": cube_mixing.op4,
    "op5_lattice_scores": lattice_lm.op5,
    "op6_url_filter": url_filter.op6,
    "op7_quality_rules": quality_rules.op7,
    "op8_feistel_sharding": feistel_sharding.op8,
    "op9_sketch_dedup": sketch_dedup.op9,
    "op10_template_decontam": template_decontam.op10,
}

SQL = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
}
