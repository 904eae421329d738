from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import files as O
from corpusloom.operators import store as S


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_scope_gate(spark):
    gate = lambda p: one(spark, O.allowed(F.col("p"), roots=["/a"], blocked=[".pem", ".env"], exclude=["*/skip/*"], include=["*.md", "*.txt", "*.env", "*.pem"]), p=p)
    assert gate("/a/x.md") and gate("/a/b/c.txt")
    assert not any(map(gate, ["/ab/x.md", "/a/x.pem", "/a/.env", "/a/skip/x.md", "/a/x.exe"]))


def test_lanes_and_types(spark):
    lanes = {"x.txt": "fast", "x.html": "fast", "x.pdf": "heavy", "x.zip": "background", "x.tar.gz": "background", "x.xyz": "heavy"}
    assert {p: one(spark, O.lane(F.col("p")), p=p) for p in lanes} == lanes
    magic = {"x.md": (b"", "text/markdown"), "x": (b"%PDF-1", "application/pdf"), "y": (b"PK\x03\x04", "application/zip"), "z": (b"RIFF\x00\x00\x00\x00WAVE", "audio/wav"), "w": (b"??", "application/octet-stream")}
    assert {p: one(spark, O.media_type(F.col("p"), F.col("h")), p=p, h=bytearray(h)) for p, (h, _) in magic.items()} == {p: m for p, (_, m) in magic.items()}
    assert one(spark, O.parser_of(F.col("p"), F.lit("application/json")), p="/x/conversations.json") == "chatgpt"


def test_retryable(spark):
    assert one(spark, O.retryable(F.col("e")), e="Connection reset") and not one(spark, O.retryable(F.col("e")), e="bad json")


def test_latest_and_drift(spark):
    files = spark.createDataFrame([("a", "/a", 1.0, 1, "indexed", 1.0), ("a", "/a", 2.0, 1, "indexed", 2.0), ("b", "/b", 1.0, 5, "indexed", 1.0), ("c", "/c", 1.0, 5, "tombstone", 1.0), (None, "/d", 1.0, 1, "x", 1.0)], "id string, path string, mtime double, size long, status string, updated_at double")
    assert {(r["id"], r["mtime"]) for r in O.latest(files).collect()} == {("a", 2.0), ("b", 1.0), ("c", 1.0)}
    listing = spark.createDataFrame([("/a", 3.0, 1)], "path string, mtime double, size long")
    assert {tuple(r) for r in O.drift(O.latest(files), listing).collect()} == {("/a", "modified"), ("/b", "deleted")}


def test_reference_counts(spark):
    counts = spark.createDataFrame([("x", 2), ("y", 1), ("z", 0)], "chunk_id string, ref_count long")
    deltas = spark.createDataFrame([("y", -1), ("z", -3), ("x", -1)], "chunk_id string, delta int")
    assert {tuple(r) for r in S.adjusted(counts, deltas).collect()} == {("x", 1, False), ("y", 0, True), ("z", 0, False)}


def test_reindex_share(spark):
    total = spark.createDataFrame([("f", 5), ("g", 10)], "file_id string, chunks long")
    changed = spark.createDataFrame([("f", 1), ("g", 1), ("h", 1)], "file_id string, changed long")
    assert {tuple(r) for r in S.reindex(total, changed).collect()} == {("f", True), ("g", False), ("h", True)}


def test_cascade_and_copies(spark):
    subs = spark.createDataFrame([("f", "c1"), ("f", "c2"), ("g", "c2")], "file_id string, chunk_id string")
    left, lost = S.cascade(subs, spark.createDataFrame([("f",)], "id string"))
    assert [tuple(r) for r in left.collect()] == [("g", "c2")] and [r[0] for r in lost.collect()] == ["c1"]
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "k long, t string")
    assert {tuple(r) for r in S.copies(rows, "k", "t").collect()} == {(1, 1, 2), (2, 1, 2), (4, 4, 1)}
