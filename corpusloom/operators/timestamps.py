"""Mixed timestamp formats and zones to one UTC instant, by way of a dictionary of distinct values.

The same raw strings come back again and again, within a batch (rows delivered twice) and between batches.
So the distinct (string, zone, locale) values are collected into a dictionary table, each is parsed exactly
once by an exhaustive parser, new ones are appended on later runs, and rows get their instant by an equi-join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.instants import parse_instant
from corpusloom.functions.workspace import path_exists, scratch_path

KEY = ["raw", "zone", "locale"]


@F.pandas_udf(T.LongType())
def _parsed(raw: pd.Series, zone: pd.Series, locale: pd.Series) -> pd.Series:
    return pd.Series([parse_instant(*x) for x in zip(raw, zone, locale)], dtype="Int64")


class TimestampDictionary:
    """A persisted table (raw, zone, locale, utc_us) that is only ever appended to.

    ``path`` is the table's place; without one it lives below the session's shared folder. Two writers must
    not extend one dictionary at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "timestamps")

    def entries(self) -> DataFrame:
        return self.spark.read.schema("raw string, zone string, locale string, utc_us long").parquet(self.path)

    def extend(self, keys: DataFrame) -> "TimestampDictionary":
        """Parse the distinct keys that the dictionary doesn't hold yet and append them, unreadable ones too."""
        new = keys.select(*KEY).where("raw is not null").distinct()
        if path_exists(self.spark, self.path):
            new = new.join(self.entries().select(*KEY), KEY, "left_anti")
        new.withColumn("utc_us", _parsed(*KEY)).write.mode("append").parquet(self.path)
        return self


def normalise_timestamps(
    rows: DataFrame, raw: str, zone: str | None = None, locale: str | None = None, *, dictionary: TimestampDictionary | None = None, out: str = "utc_us"
) -> DataFrame:
    """``rows`` with ``out``: microseconds since 1970 of the instant that column ``raw`` denotes.

    Rows whose raw time is null, blank or unreadable, is a wall time that never occurs, or lies outside
    2021 to 2025 get null in ``out``; no row is lost. Null or unknown zones count as UTC. Columns of ``rows``
    may have any names; one already called ``out`` is replaced. An empty table gives an empty table.
    """
    key = {"raw": F.col(raw), "zone": F.coalesce(F.col(zone), F.lit("")) if zone else F.lit(""), "locale": F.coalesce(F.col(locale), F.lit("")) if locale else F.lit("")}
    kept = [c for c in rows.columns if c != out]
    packed = rows.select(F.struct(*kept).alias("_row"), *(v.alias(k) for k, v in key.items()))
    dictionary = (dictionary or TimestampDictionary(rows.sparkSession)).extend(packed)
    found = dictionary.entries().where("utc_us is not null").withColumnRenamed("utc_us", "_found")
    return packed.join(found, KEY, "left").select("_row.*", F.col("_found").alias(out))


def export_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(platform, record_id, raw, zone, locale) of the three chat exports, each record once."""
    def part(platform, table, record, raw):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return df.select(F.lit(platform).alias("platform"), F.col(record).alias("record_id"), F.col(raw).alias("raw"), F.col("client_tz").alias("tz"), "locale")

    rows = part("chatgpt", "chatgpt_conversations", "conv_id", "create_time")
    rows = rows.unionByName(part("claude", "claude_messages", "uuid", "created_at"))
    rows = rows.unionByName(part("gemini", "gemini_conversations", "id", "updated_at"))
    return rows.where("record_id is not null and raw is not null").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the exports whose raw time denotes an instant: (platform, record_id, utc_us)."""
    rows = normalise_timestamps(export_times(spark, sf_dir), "raw", "tz", "locale")
    return rows.where("utc_us is not null").select("platform", "record_id", "utc_us").distinct()
