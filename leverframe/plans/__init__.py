"""Queries by theme; importing this package registers all of them."""

from leverframe.plans import effects, models, retrieval, sqltext, studies, texts, trials  # noqa: F401
from leverframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
