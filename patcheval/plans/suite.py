"""All named queries."""

from __future__ import annotations

from patcheval.plans import (  # noqa: F401 - importing a module registers its queries
    dataset_queries,
    file_queries,
    grading_queries,
    inference_queries,
    log_queries,
    report_queries,
)
from patcheval.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
