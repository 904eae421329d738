"""Every registered core query with, where one can be written, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.timestamps import p4_found
from corpusloom.plans import exports, files, graph, retrieval, store, vault

Query = Callable[[SparkSession, str], DataFrame]
ALL = {**files.QUERIES, **store.QUERIES, **retrieval.QUERIES, **graph.QUERIES, **exports.QUERIES, **vault.QUERIES, "p4_found": (p4_found, None)}


def core_queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def core_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
