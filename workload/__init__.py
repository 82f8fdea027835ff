"""Registered queries: each engine operator applied to the given tables."""

from workload import ages, coverage, matching, positions, spectra  # noqa: F401
from workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
