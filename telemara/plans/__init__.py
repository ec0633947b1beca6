"""Registered queries over the driver's tables, with their oracles."""

from . import business, detection, models, text, tiers

GROUPS = (detection, tiers, models, business, text)


def queries() -> dict:
    return {k: v for g in GROUPS for k, v in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for g in GROUPS for k, v in g.ORACLES.items()}
