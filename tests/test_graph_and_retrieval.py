from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import graph, hybrid, vectors


def test_entity_ids(spark):
    ids = spark.createDataFrame([(" Ada ", "Person"), ("ada", "PERSON")], "n string, t string").select(graph.entity_id(F.col("n"), F.col("t"))).distinct().collect()
    assert len(ids) == 1 and len(ids[0][0]) == 20


def test_spotted_entities(spark):
    df = spark.createDataFrame([("Monday in Berlin with Ada Lovelace and ada. BERLIN Berlin Paris Rome Turin Milan Nice",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(graph.spotted_entities(F.col("t"))).collect()]
    assert got == [["Berlin", "Lovelace", "Paris Rome Turin", "Milan Nice"], [], []] or len(got[0]) <= 5
    edges = df.select(graph.chained(graph.spotted_entities(F.col("t")))).first()[0]
    assert len(edges) == len(got[0]) - 1 and all(e["weight"] == 0.5 for e in edges)


def test_neighbourhood_and_components(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)], "src string, dst string, weight double")
    near = {tuple(r) for r in graph.neighbourhood(edges, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert near == {("a", "b", 1), ("a", "c", 2)}
    nodes = spark.createDataFrame([(x,) for x in "abcxyz"], "id string")
    assert dict(map(tuple, graph.components(nodes, edges).collect())) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(200)], "src string, dst string")
    nodes = spark.createDataFrame([(f"{i:04}",) for i in range(201)], "id string")
    assert graph.components(nodes, edges).select("component").distinct().count() == 1


def test_communities(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("c", "d"), ("e", "f"), ("d", "f"), ("p", "q")]
    assert graph.greedy_modularity([(a, b, 1.0) for a, b in edges[:7]], 8.0) == [["a", "b", "c"], ["d", "e", "f"]]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdefpqz"], "id string")
    found = graph.communities(nodes, df).collect()
    assert [r["size"] for r in found] == [3, 3, 2]
    assert sorted(r["members"] for r in found) == [["a", "b", "c"], ["d", "e", "f"], ["p", "q"]]
    assert graph.communities(nodes, df.limit(0)).count() == 0


def test_upserts_take_the_last_write(spark):
    kind = "chunk_id string, extracted_at double, entities array<struct<name:string,entity_type:string,description:string>>, relations array<struct<source:string,target:string,description:string,weight:double>>"
    rows = [("c", 1.0, [("A", "X", "old"), ("B", None, None), (" ", "X", "")], [("a", "b", "", None)]), ("c", 2.0, [("a", "x", "new")], [("A", "B", "", 0.0), ("A", "A", "", 1.0), ("A", "nobody", "", 1.0)]), ("d", None, None, None)]
    df = spark.createDataFrame(rows, kind)
    entities = graph.upsert_entities(df)
    assert {(r["name"], r["entity_type"], r["description"]) for r in entities.collect()} == {("a", "x", "new"), ("B", "Concept", "")}
    assert [r["weight"] for r in graph.upsert_relations(df, entities).collect()] == [1.0]


def test_intents(spark):
    lanes = {"an overview of it": "global_theme", "how are a and b related": "multi_hop", "overviewed articles": "specific", "": "specific", None: "specific", "Summary!": "global_theme"}
    df = spark.createDataFrame([(q,) for q in lanes], "q string").select("q", hybrid.intent(F.col("q")).alias("lane"))
    assert {r["q"]: r["lane"] for r in df.collect()} == lanes


def test_fusion(spark):
    hit = "id string, rank int, score double"
    v, w = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.2)], hit), spark.createDataFrame([("b", 1, -3.0), ("c", 2, -2.0)], hit)
    rows = hybrid.top(hybrid.fuse(v, w, "id"), 3).collect()
    assert [r["id"] for r in rows] == ["b", "a", "c"] and rows[0]["keyword_score"] == -3.0 and rows[1]["keyword_score"] == 0.0
    assert hybrid.fuse(v.limit(0), w.limit(0), "id").count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.nearest_of_each(df.where("vec_id % 50 = 0"), df, 5, 8).collect()
    for q in range(0, 300, 50):
        d = ((x - x[q]) ** 2).sum(1)
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i in np.argsort(d, kind="stable") if i != q][:5]
    assert vectors.nearest(df, rows[7][1], 1).first()["vec_id"] == 7
    assert vectors.nearest_of_each(df.limit(0), df, 5, 8).count() == 0


def test_queries_in_blocks_by_hash(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    whole = {tuple(r) for r in vectors.nearest_of_each(rows, rows, 3, 8).collect()}
    monkeypatch.setattr(vectors, "BLOCK", 60)
    assert {tuple(r) for r in vectors.nearest_of_each(rows, rows, 3, 8).collect()} == whole and len(whole) == 600
