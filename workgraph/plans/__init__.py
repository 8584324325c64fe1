"""Registered queries; importing a family module registers it."""

import importlib

from workgraph.plans.registry import CHECKS, QUERIES

for _family in ["history", "boards", "journals", "patches", "reviews", "code", "features", "evaluation", "texts", "streams", "io"]:
    importlib.import_module(f"workgraph.plans.{_family}")

__all__ = ["CHECKS", "QUERIES"]
