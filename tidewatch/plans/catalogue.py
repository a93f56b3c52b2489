"""All registered queries."""

from tidewatch.plans import queries_sources, queries_rates, queries_ops, queries_advice, queries_text, queries_streams  # noqa: F401, I001
from tidewatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
