"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import conversations, exact_dedup, fixity, line_dedup, mixing, near_dedup, neighbours, pieces, pseudo_likelihood, rollup, spelling, substring_dedup, toxicity

MODULES = [pieces, line_dedup, toxicity, pseudo_likelihood, exact_dedup, rollup, near_dedup, mixing, neighbours, fixity, substring_dedup, conversations, spelling]


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
