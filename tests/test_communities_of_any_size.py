from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from corpusloom.operators import graph


def test_a_large_component_is_cut(spark):
    """Two cliques of 450 joined by one edge: 202,051 edges, which came out as one community."""
    ids = spark.range(900).select(F.col("id").alias("n"), F.format_string("%03d", "id").alias("id"))
    pairs = ids.alias("s").join(ids.alias("t"), (F.col("s.n") < F.col("t.n")) & ((F.col("s.n") < 450) == (F.col("t.n") < 450)))
    edges = pairs.select(F.col("s.id").alias("src"), F.col("t.id").alias("dst"), F.lit(1.0).alias("weight"))
    edges = edges.unionByName(spark.createDataFrame([("000", "899", 1.0)], edges.schema))
    rows = graph.communities(ids.select("id"), edges).collect()
    halves = [[f"{i:03}" for i in range(450)], [f"{i:03}" for i in range(450, 900)]]
    assert sorted(r["members"] for r in rows) == halves
    assert {r["community_id"] for r in rows} == {"community_" + hashlib.sha1("|".join(h).encode()).hexdigest()[:16] for h in halves}


def test_a_hub_and_its_leaves_are_one_community(spark):
    """All leaves move to the hub at once, each counted as if those before it had moved."""
    edges = spark.createDataFrame([("hub", f"{i:02}", 1.0) for i in range(50)], "src string, dst string, weight double")
    rows = graph.community_rows(spark.createDataFrame([("hub",), ("alone",)], "id string"), edges).collect()
    assert len(rows) == 51 and {r["size"] for r in rows} == {51}
