"""Collects every registered query."""

from __future__ import annotations

import importlib

from quillon.plans.registry import ORACLES, QUERIES

MODULES = ["sources", "tabular", "joins", "vectors", "graphs", "probes", "inference", "features", "sampling", "incremental"]


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"quillon.plans.{module}_queries")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
