"""All registered queries and their SQL oracles, by family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("marts", "rules", "sheet_checks", "reports", "intake")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out.update(getattr(import_module(f"tidemark.registry.{family}"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")


def without_oracle() -> dict:
    """Queries that no SQL over the tables can state."""
    return import_module("tidemark.registry.intake").WITHOUT_ORACLE
