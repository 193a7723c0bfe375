"""Registered queries: each pairs a call into the library with the SQL that must give the same rows."""

import importlib

from queries.base import ORACLES, QUERIES

MODULES = [
    "reconcile", "integrity", "catalog", "planning", "translation", "metrics", "progress", "retrieval", "loading", "streams", "extensions",
]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"queries.{name}")


__all__ = ["ORACLES", "QUERIES", "load_all"]
