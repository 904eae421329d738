from __future__ import annotations

from datetime import datetime, timezone

import pytest

from corpusloom.functions.instants import parse_instant
from corpusloom.operators.timestamps import TimestampDictionary, normalise_timestamps


def us(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1e6)


@pytest.mark.parametrize(
    "raw, zone, locale, expected",
    [
        ("1700000000", None, None, "2023-11-14T22:13:20"), ("1700000000123", None, None, "2023-11-14T22:13:20.123"), ("1700000000123456789", None, None, "2023-11-14T22:13:20.123456"),
        ("1.7E9", None, None, "2023-11-14T22:13:20"), ("2023-06-01T12:00:00.1234567Z", None, None, "2023-06-01T12:00:00.123456"), ("2023-06-01 12:00:00+0530", "Asia/Tokyo", None, "2023-06-01T06:30:00"),
        ("2023-06-01T12:00:00", "Europe/Paris", "fr_FR", "2023-06-01T10:00:00"), ("2023-06-01T12:00:00", "No/Where", None, "2023-06-01T12:00:00"), ("20230601T120000Z", None, None, "2023-06-01T12:00:00"),
        ("06/01/2023 12:00", None, "en_US", "2023-06-01T12:00:00"), ("06/01/2023 12:00", None, "en_GB", "2023-01-06T12:00:00"), ("1.6.23, 12:00:05", "UTC", "de_DE", "2023-06-01T12:00:05"),
        ("Jun 1, 2023, 12:05:08 AM PDT", None, "en_US", "2023-06-01T07:05:08"), ("1. März 2023, 12:00:00 MEZ", None, "de_DE", "2023-03-01T11:00:00"), ("1 août 2023 à 12:00", None, "fr_FR", "2023-08-01T12:00:00"),
        ("Thu, 01 Jun 2023 12:00:00 +0200", None, None, "2023-06-01T10:00:00"), ("2023/06/01 12:00:00 GMT+5:30", None, None, "2023-06-01T06:30:00"),
        ("2023-10-29T02:30:00", "Europe/Berlin", None, "2023-10-29T00:30:00"),  # occurs twice: the earlier
        ("2023-10-29T02:30:00+01:00[Europe/Berlin]", None, None, "2023-10-29T01:30:00"),
    ],
)
def test_readable(raw, zone, locale, expected):
    assert parse_instant(raw, zone, locale) == us(expected)


@pytest.mark.parametrize("raw", [None, "", "  ", "0", "-1", "N/A", "yesterday", "0000-00-00 00:00:00", "2023-02-30T00:00:00Z", "2020-12-31T23:59:59Z", "2026-01-01T00:00:00Z", "2023-06-01T12:00:00 XYZ", "9" * 40, "x" * 5000])
def test_unreadable(raw):
    assert parse_instant(raw, "Europe/Berlin", "de_DE") is None


def test_wall_time_that_never_occurs():
    assert parse_instant("2023-03-26T02:30:00", "Europe/Berlin", None) is None


def test_rows_keep_their_columns_and_dictionary_grows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "1700000000", "a"), (2, None, "b"), (3, "nonsense", None), (4, "1700000000", "c")], "raw_id int, raw string, zone string")
    d = TimestampDictionary(spark, f"file://{tmp_path}/times")
    out = normalise_timestamps(rows, "raw", dictionary=d, out="raw_us").orderBy("raw_id").collect()
    assert [r["raw_us"] for r in out] == [us("2023-11-14T22:13:20"), None, None, us("2023-11-14T22:13:20")]
    assert d.entries().count() == 2
    more = spark.createDataFrame([("1700000001",), ("nonsense",)], "raw string")
    normalise_timestamps(more, "raw", dictionary=d).collect()
    assert d.entries().count() == 3
    assert normalise_timestamps(more.limit(0), "raw").count() == 0
