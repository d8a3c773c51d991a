"""Queries of the numbered operators and the SQL of those that SQL can express."""

from __future__ import annotations

from barloom.llm import collocations, decontaminate, licenses, line_dedup, near_dedup, neighbours, packing, quality_cnn, quality_rules, substring_dedup, toxicity, vector_codes, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_warc_derivatives": warc.op6_warc_derivatives,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_quality_cnn": quality_cnn.op9_quality_cnn,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES = {
    "op2_near_dedup": near_dedup.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op4_substring_dedup": substring_dedup.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
