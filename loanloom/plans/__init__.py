"""Operators applied to the shared tables.  Importing this package registers every query."""

from importlib import import_module

from loanloom.plans.registry import ORACLES, QUERIES

for _part in ("preparation", "summaries", "risk", "assurance", "memos", "modelling", "streams"):
    import_module(f"loanloom.plans.{_part}")

__all__ = ["ORACLES", "QUERIES"]
