"""All registered queries."""

from vecloom.plans import search_queries, table_queries, text_queries  # noqa: F401
from vecloom.plans.registry import ORACLES, QUERIES  # noqa: F401
