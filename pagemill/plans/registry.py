"""All queries and their SQL."""

from pagemill.plans import account_queries, layout_queries, store_queries, text_queries

_MODULES = (text_queries, layout_queries, store_queries, account_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
