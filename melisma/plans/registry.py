"""All queries of the engine and their SQL. The modules of queries register themselves here."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "rrf_fusion"


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name, and the SQL that gives the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def load_all() -> None:
    for m in ("text", "vectors", "catalog", "evidence", "taste", "identity", "library", "learning", "evaluation", "assembly", "requests", "prompts", "discovery", "packs"):
        importlib.import_module(f"melisma.plans.{m}")


load_all()
