"""Registered queries: operators bound to the test tables, each with its oracle SQL."""

from postmill.catalog import archiving, flows, keyed, matching, questions, rules, sourcing, texts, workflows  # noqa: F401
from postmill.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
