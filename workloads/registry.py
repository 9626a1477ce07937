"""Name to (Spark query, SQL) registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pageloom.plans.stage import checkpoint_dir
from workloads.sql_views import sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``oracle`` is its SQL, if it has one."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return fn
    return register


def shared_dir(spark, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
