from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import workspace
from corpusloom.operators import context, files, graph, search
from corpusloom.operators import store as S
from corpusloom.plans import exports


def test_index_is_read_by_term(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Übung macht den Meister, naïve ÜBUNG"), (2, "the übung of others"), (3, None), (4, "東京 tower"), (5, "")], "doc_id long, text string")
    tokens = docs.select("doc_id", search.folded_tokens(docs["text"]).alias("tokens"))
    index = search.Index(spark, f"file://{tmp_path}/i").add(tokens.where("doc_id < 3")).add(tokens.where("doc_id >= 3"))
    assert index.totals.first()["n"] == 5
    found = index.search([["ubung"]])
    assert {r["doc_id"] for r in found.collect()} == {1, 2} and {r["doc_id"] for r in index.search([["東京"]]).collect()} == {4}
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(term,ubung\)", found._jdf.queryExecution().toString())
    assert index.search([]).count() == 0 and index.search([["no", "such"]]).count() == 0
    one = search.search(*search.index(tokens, "doc_id"), "doc_id", [["ubung"]])
    scores = lambda df: {r["doc_id"]: round(r["score"], 9) for r in df.collect()}
    assert scores(one) == scores(found) == scores(index.compacted(f"file://{tmp_path}/all").search([["ubung"]]))
    empty = search.Index(spark, f"file://{tmp_path}/none")
    assert empty.search([["a"]]).count() == 0 and empty.add(tokens.limit(0)).search([["a"]]).count() == 0


def test_entities_named_and_what_lies_around(spark):
    entities = spark.createDataFrame([("e1", "Ada Lovelace"), ("e2", "ada"), ("e3", "Zoë's"), ("e4", ""), ("e5", None), ("e6", "Charles Babbage the Elder")], "id string, name string")
    texts = spark.createDataFrame([(1, "By ADA lovelace, and Charles Babbage the elder."), (2, "adage; zoe s"), (3, None), (4, "Ada ada Ada")], "doc_id long, text string")
    named = context.named_in(texts, "doc_id", "text", entities)
    assert {tuple(r) for r in named.collect()} == {(1, "e1"), (1, "e2"), (1, "e6"), (2, "e3"), (4, "e2")}
    assert context.named_in(texts, "doc_id", "text", entities.limit(0)).count() == 0
    edges = spark.createDataFrame([("e2", "x", 1.0), ("x", "y", 1.0), ("e1", "x", 1.0), ("y", "z", 1.0)], "src string, dst string, weight double")
    assert {tuple(r) for r in context.around(named, "doc_id", edges, 2).where("doc_id = 4").collect()} == {(4, "x", 1), (4, "y", 2), (4, "e1", 2)}


def test_only_runs_that_may_be_names_are_joined(spark):
    entities = spark.createDataFrame([("e1", "w1 w2 w3"), ("e2", "w7"), ("e3", "w9 w1")], "id string, name string")
    texts = spark.createDataFrame([(d, " ".join(f"w{(d * 13 + i) % 50}" for i in range(40))) for d in range(300)] + [(900, "w1 w2"), (901, "w3"), (902, "x w9 W1 w2 w3 w7")], "doc_id long, text string")
    named = context.named_in(texts, "doc_id", "text", entities)
    held = {(d, e) for d, t in texts.collect() for e, n in entities.collect() if f" {n} " in f" {t.lower()} "}
    assert {tuple(r) for r in named.collect()} == held and {(902, e) for e in ("e1", "e2", "e3")} <= held
    assert "MapInArrow" in named._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_counted_without_being_listed(spark, monkeypatch):
    ids = [f"e{i}" for i in range(60)]
    edges = spark.createDataFrame([(ids[i], ids[(i * 7 + k) % 60], 1.0) for i in range(50) for k in (1, 2)], "src string, dst string, weight double").where("src <> dst")
    named = spark.createDataFrame([(d, ids[(d * 11 + k) % 60]) for d in range(200) for k in range(d % 4)] + [(500, "alone")], "doc_id long, id string")
    for hops in (1, 2, 3):
        expected = {tuple(r) for r in context.around(named, "doc_id", edges, hops).groupBy("doc_id", "hop").count().collect()}
        for held in (context.HELD, 30):
            assert {tuple(r) for r in context.counts_around(named, "doc_id", edges, hops, held).collect()} == expected
    assert context.counts_around(named, "doc_id", edges.limit(0)).count() == 0 and context.counts_around(named.limit(0), "doc_id", edges).count() == 0
    wide = spark.createDataFrame([(0, f"h{i}") for i in range(300)], "doc_id long, id string").select("id")
    wide = wide.crossJoin(wide.withColumnRenamed("id", "dst")).select(F.col("id").alias("src"), "dst").where("src < dst")
    largest, write = [], context.materialise
    monkeypatch.setattr(context, "materialise", lambda df, name="step": largest.append((name, (out := write(df, name)).count())) or out)
    asked = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("h1").alias("id"))
    assert {tuple(r)[1:] for r in context.counts_around(asked, "doc_id", wide).collect()} == {(1, 299)} and max(n for _, n in largest) < 100_000


def test_hits_keep_their_chunks_without_files(spark):
    hits = spark.createDataFrame([("c1", 1.0), ("c2", 2.0)], "chunk_id string, score double")
    held = spark.createDataFrame([("f1", "c1", 0), ("f2", "c1", 4)], "file_id string, chunk_id string, sequence int")
    got = {(r["chunk_id"], r["file_id"], r["path"]) for r in context.with_files(hits, held, spark.createDataFrame([("f1", "/a")], "id string, path string")).collect()}
    assert got == {("c1", "f1", "/a"), ("c1", "f2", None), ("c2", None, None)}


def test_names_in_texts_of_other_scripts(spark):
    rows = [("“Bram Mezur” met Élodie Marchand in Kraków; «Vera Mills» didn't. naïveBram Xxxxx",), ("Harbour Master of Łódź Harbour",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(graph.spotted_entities(F.col("t"))).collect()]
    assert got == [["Bram Mezur", "Marchand", "Vera Mills", "Xxxxx"], ["Harbour Master", "Harbour"]]


def test_every_conversation_comes_out_once(spark, sf_dir):
    every = spark.read.parquet(f"{sf_dir}/claude_messages.parquet").select("conversation_uuid").distinct().count()
    a, b = ({r["conv_id"] for r in q(spark, sf_dir).collect()} for q in (exports.claude_transcripts, exports.claude_transcripts_by_time))
    assert not a & b and len(a | b) == every


def test_purge_takes_only_what_nothing_else_holds(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = S.purged(df([("f1",), ("f3",)], "file_id string"), df([("f1", "c1", 0), ("f1", "c2", 1), ("f2", "c2", 0)], "file_id string, chunk_id string, sequence int"),
                   df([("f1", "i1"), ("f2", "i2")], "file_id string, id string"), df([("c1", "i1"), ("c2", "i2")], "chunk_id string, id string"), df([("i1",), ("i1",), ("i2",)], "id string"))
    assert {tuple(r) for r in got.collect()} == {("f1", 2, 1, 1, 2), ("f3", 0, 0, 0, 0)}


def test_magic_bytes_decide_without_an_extension(spark):
    rows = [("/a", b"%PDF-1"), ("/b", b"\x89PNG"), ("/c", b"RIFF0000WAVE"), ("/d", b"x"), ("/e.txt", b"%PDF"), ("/f", None)]
    df = spark.createDataFrame(rows, "path string, head binary")
    got = [r[0] for r in df.select(files.media_type(df["path"], df["head"])).collect()]
    assert got == ["application/pdf", "image/png", "audio/wav", "application/octet-stream", "text/plain", "application/octet-stream"]


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Fake:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Fake.conf)

    with pytest.raises(ValueError):
        workspace.shared_dir(Fake)
