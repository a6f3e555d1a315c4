"""All registered queries."""

from verbatlas.plans import load_queries, table_queries, text_queries  # noqa: F401  registers them
from verbatlas.plans.registry import ORACLE, QUERIES  # noqa: F401
