"""Bindings of the operators to concrete tables, and the registered queries."""

from trialstats.plans import queries_apply, queries_data, queries_formula, queries_logs, queries_models, queries_smooth, queries_tests  # noqa: F401  (register on import)
from trialstats.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
