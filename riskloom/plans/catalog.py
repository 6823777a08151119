"""All queries by name, with their check SQL where SQL can follow."""

from __future__ import annotations

from riskloom.plans import log_queries, model_queries, policy_queries, stream_queries

ALL = {
    **log_queries.QUERIES, **model_queries.QUERIES,
    **policy_queries.QUERIES, **stream_queries.QUERIES,
}
