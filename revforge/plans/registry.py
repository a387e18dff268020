"""Registry of every query: ``queries()`` (Spark) and ``oracle_sql()`` (DuckDB) keyed alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chains, evaluate, gradient, logs, models, oracle_chains, oracle_evaluate, oracle_logs, oracle_models, oracle_prep, oracle_scored, oracle_stem, oracle_text, prep, text


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for mod in _modules():
        out.update(mod.QUERIES)
    return out


def all_oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for mod in _oracle_modules():
        out.update(mod.SQL)
    return out


def _modules():
    return [prep, text, evaluate, logs, models, gradient, chains]


def _oracle_modules():
    return [oracle_prep, oracle_text, oracle_stem, oracle_chains, oracle_scored, oracle_evaluate, oracle_logs, oracle_models]
