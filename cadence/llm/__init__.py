"""Operators for training-data pipelines; see README.md beside this file."""

from cadence.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
