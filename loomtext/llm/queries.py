"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Queries by module.
NAMES = {
    "abuse": ["p10_found", "p10_scores", "p10_rates"],
    "copies": ["p2_found", "p2_collapsed"],
    "encoding": ["p3_found", "p3_restored"],
    "leakage": ["p9_found", "p9_leaks", "p9_clean"],
    "lookalikes": ["p6_found", "p6_normalised", "p6_equal_terms"],
    "nearcopies": ["p5_found", "p5_groups"],
    "packing": ["p8_packed", "p8_fill"],
    "pagenoise": ["p1_found", "p1_pages"],
    "pairs": ["p4_found", "p4_rates"],
    "splitting": ["p7_found", "p7_pieces"],
}


def queries() -> dict:
    return {q: getattr(import_module(f"loomtext.llm.{m}"), q) for m, qs in NAMES.items() for q in qs}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in NAMES:
        out |= getattr(import_module(f"loomtext.llm.{m}"), "ORACLE", {})
    return out
