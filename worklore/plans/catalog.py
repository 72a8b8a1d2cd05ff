"""All registered queries."""

from worklore.plans import q_features, q_ledger, q_projects, q_reports, q_runs, q_search, q_sources, q_streams, q_text, q_upsert  # noqa: F401
from worklore.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
