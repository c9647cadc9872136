"""Everything registered."""

from tidemark.plans import (  # noqa: F401
    content_queries,
    job_queries,
    manifest_queries,
    session_queries,
    stream_queries,
    sync_queries,
    tree_queries,
)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
