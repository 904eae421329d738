"""The public API over a vault folder: ingest, list, look up, search, drift, purge.

A vault holds Parquet tables ``files`` (versions), ``documents`` (doc_id, text), ``chunks`` and ``events``. Methods return
DataFrames and check their bounds; nothing is collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.workspace import scratch_path
from corpusloom.operators import files as file_ops
from corpusloom.operators import hybrid, search, vectors
from corpusloom.sources import parsers
from corpusloom.sources.tables import table
from corpusloom.streaming import ingest


class BoundsError(ValueError):
    """A parameter is outside what a method accepts."""


def bounded(name: str, value: int, low: int, high: int | None = None) -> int:
    if value < low or high is not None and value > high:
        raise BoundsError(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else ""))
    return value


class Session:
    def __init__(self, spark: SparkSession, vault: str, *, hybrid_enabled: bool = True):
        self.spark, self.vault, self.hybrid_enabled = spark, vault, hybrid_enabled
        self._built: search.Index | None = None

    def _files(self) -> DataFrame:
        return file_ops.latest(table(self.spark, self.vault, "files"))

    def ingest(self, root: str, most: int = 100 * 1024 * 1024, **gate) -> DataFrame:
        """Take the files below a folder that pass the size limit and the scope gate (see ``operators.files.allowed``) into the vault's
        store, where they replace what their paths held before; (path, chunks, operation) of what changed."""
        found = parsers.scan_directory(self.spark, root).where(file_ops.within_size(F.col("size"), most))
        gate.setdefault("roots", [root.removeprefix("file://")])
        parsed = parsers.parse_files(found.where(file_ops.allowed(F.col("path"), **gate)).select("path", "content"))
        store = f"{self.vault}/store"
        number = (ingest.journal(self.spark, store, "string").agg(F.max("batch")).first()[0] or 0) + 1
        ingest.ingest_batch(parsed.select(F.col("path").alias("doc_id"), "text"), number, store)
        return ingest.journal(self.spark, store, "string").where(F.col("batch") == number).select(F.col("doc_id").alias("path"), "chunks", "operation")

    def held(self) -> DataFrame:
        """(doc_id, fingerprint, sequence) of what ingested files hold now."""
        return ingest.subscriptions(self.spark, f"{self.vault}/store", "string")

    def _index(self) -> search.Index:
        """The index of the vault's documents, built when it is first needed."""
        if self._built is None:
            tokens = search.stemmed_tokens(table(self.spark, self.vault, "documents"), "doc_id", "text")
            self._built = search.Index(self.spark, scratch_path(self.spark, "index")).add(tokens)
        return self._built

    def list_files(self, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        rows = file_ops.list_files(self._files(), status)
        return file_ops.page(rows, [F.desc("updated_at"), F.col("id")], bounded("limit", limit, 1, 1000), bounded("offset", offset, 0))

    def get_file(self, id: str) -> DataFrame:
        return self._files().where(F.col("id") == id)

    def search(self, q: str, limit: int = 10, mode: str = "keyword", vector: list[float] | None = None) -> DataFrame:
        """Keyword, semantic (by a given vector) or hybrid hits over documents: (doc_id, score) or (doc_id, ..., rrf)."""
        bounded("limit", limit, 1, 100)
        bounded("length of q", len(q), 1)
        if mode not in ("keyword", "semantic", "hybrid"):
            raise BoundsError("mode must be keyword, semantic or hybrid")
        if mode == "hybrid" and not self.hybrid_enabled:
            raise BoundsError("hybrid search is not enabled")
        if mode == "semantic" and vector is None:
            raise BoundsError("semantic search needs a vector")
        near = None
        if vector is not None:
            rows = table(self.spark, self.vault, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
            near = vectors.nearest(rows, vector, limit, key="doc_id").select("doc_id", F.col("distance").alias("score"))
        if mode == "semantic":
            return near
        found = self._index().search(search.query_phrases(q, stemmed=True)).orderBy("score", "doc_id").limit(limit)
        if mode == "keyword":
            return found
        near = found.limit(0) if near is None else near
        ranked = lambda df: df.withColumn("rank", F.expr("row_number() over (order by score, doc_id)"))  # noqa: E731 - at most 100 rows
        return hybrid.top(hybrid.fuse(ranked(near), ranked(found), "doc_id"), limit)

    def queue(self) -> DataFrame:
        return table(self.spark, self.vault, "events").groupBy("event_type").agg(F.count("*").alias("depth"))

    def sync(self, root: str) -> DataFrame:
        """What drifted between the vault and a folder."""
        return file_ops.drift(self._files(), parsers.scan_directory(self.spark, root).select("path", "mtime", "size"))

    def purge(self, now: float, days: int = 7) -> DataFrame:
        return file_ops.purgeable(self._files(), now, bounded("days", days, 0))
