"""Queries over the given tables: facts, analyses and the registry."""

from tallywright.plans import analyses, contracts, ledger, packs, schedules, values
from tallywright.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analyses", "contracts", "ledger", "packs", "schedules", "values"]
