"""The queries over the project's tables."""

from __future__ import annotations

import importlib

_MODULES = ("shredding", "metrics", "annotated", "similarity", "rollup", "dataset", "files", "generic", "running")


def _load():
    from quaestor.plans import core

    for m in _MODULES:
        importlib.import_module(f"quaestor.plans.{m}")
    return core


def all_queries():
    return _load().QUERIES


def all_sql():
    return _load().ORACLE
