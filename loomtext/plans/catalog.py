"""All queries outside the llm subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["loomtext.plans.queries_text", "loomtext.plans.queries_flow"]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(m).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(m).ORACLE
    return out
