"""The catalogue of queries over the tables."""

from gristmill.plans import archives, days, evaluation, feeds, gates, grammar, inference, labels, listings, live, models, notices, ordered, places, relational, sending, statistics, studies, texts  # noqa: F401
from gristmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
