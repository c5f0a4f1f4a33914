"""Registered queries over the given and derived tables."""

from . import graph, notes, retrieve, rules, sources, telemetry  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
