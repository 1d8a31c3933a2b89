"""All registered queries."""

from __future__ import annotations

# Importing a module registers its queries.
from calibrant.plans import (  # noqa: F401
    catalog_audits,
    catalog_data,
    catalog_inference,
    catalog_runs,
    catalog_scores,
    catalog_text,
)
from calibrant.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
