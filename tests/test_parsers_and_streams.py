from __future__ import annotations

import io
import json
import tarfile
import time
import zipfile

from corpusloom.operators.exports import sessions_of_rows
from corpusloom.sources import parsers as P
from corpusloom.streaming import ingest


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def parsed(spark, files):
    return {r["path"]: r for r in P.parse_files(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}


def test_chatgpt_takes_the_current_branch(spark):
    node = lambda parent, role, text: {"parent": parent, "message": {"author": {"role": role}, "content": {"parts": [text, {"image": 1}]}, "metadata": {"model_slug": "m"}}}
    mapping = {"r": {"parent": None}, "u": node("r", "user", "Hi"), "a": node("u", "assistant", "old"), "b": node("u", "assistant", "new")}
    tree = {"title": "T", "create_time": 1700000000, "mapping": mapping, "current_node": "b"}
    loop = {"title": "L", "mapping": {"a": node("b", "user", "x"), "b": node("a", "tool", "y")}, "current_node": "a"}
    got = parsed(spark, {"/a/conversations.json": json.dumps([tree, tree | {"current_node": "gone"}, loop]).encode(), "/b/conversations.json": b"{", "/c/conversations.json": b"[]", "/d/conversations.json": None,
                         "/e/chatgpt.zip": zipped(**{"conversations.json": "[]"}), "/f/chatgpt.zip": b"?"})
    assert got["/a/conversations.json"]["text"].startswith("# T\n\n**User:** Hi\n\n**Assistant:** new\n\n---\n\n# T\n\n**User:** Hi\n\n**Assistant:** old\n\n**Assistant:** new\n")
    about = json.loads(got["/a/conversations.json"]["metadata"])
    assert about["conversation_count"] == 3 and [c["message_count"] for c in about["conversations"]] == [2, 3, 2]
    assert all("error" in got[p]["metadata"] for p in ("/b/conversations.json", "/d/conversations.json", "/f/chatgpt.zip")) and json.loads(got["/c/conversations.json"]["metadata"])["conversation_count"] == 0
    assert [m["name"] for m in got["/e/chatgpt.zip"]["members"]] == ["conversations.json"]


def test_claude_gemini_generic(spark, tmp_path):
    got = parsed(spark, {
        "/claude.json": json.dumps([{"name": "N", "chat_messages": [{"sender": "human", "text": "Hi"}, {"role": "assistant", "content": [{"text": "a"}, "b"], "files": [1]}]}]).encode(),
        "/gemini.json": json.dumps({"title": "G", "messages": [{"prompt": "p", "response": "r"}, {"role": "user", "content": "c"}]}).encode(), "/gemini.html": b"<div>a<br/>b < c</div><STYLE>x</STYLE><i>d</i>",
        "/perplexity.json": json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "x", "content": "a"}]}).encode(), "/perplexity.md": b"# T\n**Question:** a",
    })
    assert got["/claude.json"]["text"] == "# N\n\n**User:** Hi\n\n**Assistant:** a\nb\n"
    assert got["/gemini.json"]["text"] == "# G\n\n**User:** p\n\n**Gemini:** r\n\n**User:** c\n" and got["/gemini.html"]["text"] == "a\nb < c\nd"
    assert got["/perplexity.json"]["text"] == "# Untitled\n\n**User:** q\n\n**AI:** a\n" and got["/perplexity.md"]["text"].startswith("# T")
    (tmp_path / "copilot.csv").write_text('SessionId,Role,Content\n1,user,"a\nb"\n2,bot,b\n1,bot,c\n,user,lost\n')
    rows = sessions_of_rows(P.read_sessions(spark, f"file://{tmp_path}/copilot.csv"), "session", "at", "who", "said").collect()
    assert {r["session"]: r["transcript"] for r in rows}["1"] == "# Session: 1\n\n**User:** a\nb\n\n**AI:** c\n" and len(rows) == 3


def test_archives_keep_their_limits(spark, monkeypatch):
    data = zipped(a="1", b__c="22", b__c__d__e="3")
    assert [n for n, _ in P._archive_members("x.zip", data)] == ["a", "b/c"]
    monkeypatch.setattr(P, "MOST_MEMBERS", 1)
    assert len(P._archive_members("x.zip", data)) == 1
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("m.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert P._archive_members("x.tgz", out.getvalue()) == [("m.txt", b"abc")]
    body = '<w:document xmlns:w="w"><w:p><w:t>One</w:t></w:p><w:p><w:t> </w:t></w:p><w:p><w:t>Two</w:t></w:p></w:document>'
    got = parsed(spark, {"/a.docx": zipped(**{"word/document.xml": body}), "/b.docx": zipped(x="y"), "/x.zip": b"no", "/a.txt": b"caf\xe9\n", "/p.pdf": b"%PDF", "/s.mp3": None})
    assert got["/a.docx"]["text"] == "One\n\nTwo" and "error" in got["/b.docx"]["metadata"] and "error" in got["/x.zip"]["metadata"]
    assert json.loads(got["/a.txt"]["metadata"])["line_count"] == 2 and got["/a.txt"]["text"] == "café\n" and json.loads(got["/s.mp3"]["metadata"])["needs_transcription"] and got["/p.pdf"]["text"] == ""


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n.md").write_text("# hi")
    (tmp_path / "in" / "x.zip").write_bytes(zipped(**{"inner.txt": "inside"}))
    (tmp_path / "in" / "bad.docx").write_bytes(b"junk")
    parsed_ = P.parse_files(P.scan_directory(spark, f"file://{tmp_path}/in"))
    got = {r["path"].rsplit("/", 1)[1]: r for r in parsed_.collect()}
    assert got["n.md"]["text"] == "# hi" and "error" in got["bad.docx"]["metadata"]
    assert [r["text"] for r in P.parse_files(P.expand_members(parsed_)).collect()] == ["inside"]


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    src, vault = f"file://{tmp_path}/src", f"file://{tmp_path}/vault"
    spark.createDataFrame([(1, "a" * 50), (2, "b" * 50), (3, "a" * 50), (4, None)], "doc_id long, text string").write.parquet(src)
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(src)
    ingest.ingest(stream(), vault, f"{tmp_path}/check").awaitTermination()
    spark.createDataFrame([(5, "a" * 50), (6, "c" * 50)], "doc_id long, text string").write.mode("append").parquet(src)
    ingest.ingest(stream(), vault, f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{vault}/chunks").count() == 3
    assert ingest.subscriptions(spark, vault).count() == 5
    again = lambda rows, n: ingest.ingest_batch(spark.createDataFrame(rows, "doc_id long, text string"), n, vault)
    again([(5, "a" * 50), (6, "c" * 50)], 1)
    assert spark.read.parquet(f"{vault}/chunks").count() == 3
    again([(5, "d" * 50), (6, None), (1, "a" * 50), (77, None), (None, "x")], 2)  # one changed, one deleted, one as it was, one never known
    assert {(r["doc_id"], r["operation"]) for r in ingest.journal(spark, vault).where("batch = 2").collect()} == {(5, "UPSERT"), (6, "DELETE")}
    assert {r["doc_id"] for r in ingest.subscriptions(spark, vault).collect()} == {1, 2, 3, 5}
    assert ingest.committed(spark, vault, "chunks", "fingerprint string").count() == 4
    again([(6, "c" * 50)], 3)
    assert ingest.subscriptions(spark, vault).where("doc_id = 6").count() == 1 and ingest.committed(spark, vault, "chunks", "fingerprint string").count() == 4


def test_windows_and_debounce_in_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"file://{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/ev")
    q = ingest.tumbling(stream.withColumn("ts", stream["ts"].cast("timestamp"))).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumbled").count() == ingest.tumbling(events).count()
    q = ingest.debounced(stream.withColumn("ts", stream["ts"].cast("timestamp")), "user_id", "ts", "365 days").writeStream.format("memory").queryName("calm").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("calm").count() == events.select("user_id").distinct().count()


def test_settled_files(spark, tmp_path):
    sight = "path string, size long, at string"
    first = spark.createDataFrame([("/a", 1, "2024-01-01 00:00:00"), ("/a", 1, "2024-01-01 00:00:02"), ("/b", 1, "2024-01-01 00:00:00"), ("/b", 2, "2024-01-01 00:00:03")], sight)
    first.write.parquet(f"file://{tmp_path}/s")
    time.sleep(1.1)
    spark.createDataFrame([("/c", 1, "2024-01-01 00:00:06")], sight).write.mode("append").parquet(f"file://{tmp_path}/s")
    stream = spark.readStream.schema(sight).option("maxFilesPerTrigger", 20).parquet(f"file://{tmp_path}/s").selectExpr("path", "size", "cast(at as timestamp) as ts")
    q = ingest.settled(stream).writeStream.format("memory").queryName("settled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("/a", 1, True) in {tuple(r) for r in spark.table("settled").collect()}
