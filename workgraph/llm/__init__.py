"""Operators for preparing training text; nothing outside this folder imports it."""

from workgraph.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
