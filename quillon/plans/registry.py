"""Named queries over the test tables, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name, with its SQL when SQL can express it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def h32(seed, expr: str) -> str:
    """SQL text of the seeded 32-bit hash used by the library."""
    return f"(('0x' || substr(md5('{seed}:' || {expr}), 1, 8))::BIGINT)"


def uni(seed, expr: str) -> str:
    return f"({h32(seed, expr)} / 4294967296.0::DOUBLE)"


def vec(expr: str) -> str:
    return f"({expr})::DOUBLE[]"
