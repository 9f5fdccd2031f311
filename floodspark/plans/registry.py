"""Registered queries: name -> (function of spark and sf_dir, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from floodspark.sources.views import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Register a function under its name; ``text`` may name the views of ``floodspark.sources.views``."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(" ".join(text.split()) if "--" not in text else text)
        return f

    return add
