"""The named queries over the reference tables, and their SQL."""

from termloom.plans import corpus_queries, retrieval_queries, web_queries  # noqa: F401
from termloom.plans.registry import QUERIES, SQL  # noqa: F401
