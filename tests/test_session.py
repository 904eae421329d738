from __future__ import annotations

import pytest

from corpusloom.session import BoundsError, Session


def test_session(spark, sf_dir, tmp_path):
    s = Session(spark, sf_dir)
    (tmp_path / "in").mkdir()
    listed = s.list_files(limit=5).collect()
    assert 0 < len(listed) <= 5 and s.get_file(listed[0]["id"]).count() == 1
    assert s.queue().count() == 5 and s.purge(4e9, 0).count() >= 0
    hits = s.search("missing", limit=3).collect()
    assert len(hits) <= 3 and hits == sorted(hits, key=lambda r: r["score"])
    vector = list(spark.read.parquet(f"{sf_dir}/embeddings.parquet").first()["embedding"])
    assert s.search("x", mode="semantic", vector=vector).count() == 10
    assert s.search("missing", limit=5, mode="hybrid", vector=vector).count() == 5
    (tmp_path / "in" / "note.md").write_text("# hello")
    (tmp_path / "in" / "big.txt").write_text("x" * 2000)
    v, root = Session(spark, f"file://{tmp_path}/vault"), f"file://{tmp_path}/in"
    assert [(r["chunks"], r["operation"]) for r in v.ingest(root, most=1000).collect()] == [(1, "UPSERT")]
    assert v.ingest(root, most=1000).count() == 0 and v.held().count() == 1
    (tmp_path / "in" / "note.md").write_text("# hello again")
    before = v.held().first()["fingerprint"]
    assert v.ingest(root).count() == 2 and v.held().count() == 2 and before not in {r["fingerprint"] for r in v.held().collect()}
    assert s.sync(f"file://{tmp_path}/in").where("event = 'deleted'").count() > 0


@pytest.mark.parametrize("call", [lambda s: s.list_files(limit=0), lambda s: s.list_files(offset=-1), lambda s: s.search(""), lambda s: s.search("a", limit=101), lambda s: s.search("a", mode="x"), lambda s: s.search("a", mode="semantic"), lambda s: s.purge(0.0, -1)])
def test_bounds(spark, sf_dir, call):
    with pytest.raises(BoundsError):
        call(Session(spark, sf_dir))
    with pytest.raises(BoundsError):
        Session(spark, sf_dir, hybrid_enabled=False).search("a", mode="hybrid")
