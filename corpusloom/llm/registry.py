"""The registered queries of this subpackage and, where one can be written, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.conversations import p3_found
from corpusloom.llm.history_dedup import p2_found
from corpusloom.llm.leakage import p7_found
from corpusloom.llm.name_variants import p5_found
from corpusloom.llm.neighbours import p1_found
from corpusloom.llm.spam_pages import p8_found
from corpusloom.llm.tokenize import p6_ids


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}


def llm_sql() -> dict[str, str]:
    return {}
