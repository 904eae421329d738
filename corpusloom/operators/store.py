"""Chunk state: content-addressed chunks, their subscriptions, reference counts, cascades, journal and queues.

A chunk is identified by its fingerprint, in lower case. Reference counts are derived from live subscriptions rather
than kept as counters, so they can't drift. All are set operations: joins, anti-joins and grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_chunks(arrivals: DataFrame, key: str = "fingerprint", order: str = "chunk_rowid") -> DataFrame:
    """One row per fingerprint: the first row's id, the last row's content and offsets. Null and empty keys are left out."""
    rows = arrivals.withColumn(key, F.lower(key)).where(F.coalesce(F.length(key), F.lit(0)) > 0)
    latest = F.max_by(F.struct("content", "byte_offset", "byte_length"), F.struct(order, "id")).alias("_last")
    merged = rows.groupBy(key).agg(F.min_by("id", F.struct(order, "id")).alias("id"), latest, F.count("*").alias("versions"))
    return merged.select("id", key, F.col("_last.content").alias("content"), F.col("_last.byte_offset").alias("byte_offset"), F.col("_last.byte_length").alias("byte_length"), "versions")


def subscriptions(arrivals: DataFrame) -> DataFrame:
    """(file_id, chunk_id, sequence) of the last position at which a file holds a chunk, by lower-case fingerprint."""
    rows = arrivals.select("file_id", F.lower("fingerprint").alias("chunk_id"), F.col("chunk_seq").alias("sequence")).where("file_id is not null and chunk_id <> ''")
    return rows.groupBy("file_id", "chunk_id").agg(F.max("sequence").alias("sequence"))


def live(subscribed: DataFrame, files: DataFrame) -> DataFrame:
    """Subscriptions of files that exist and are not tombstones."""
    return subscribed.join(files.where("status <> 'tombstone'").select(F.col("id").alias("file_id")), "file_id", "left_semi")


def ref_counts(chunks: DataFrame, subscribed: DataFrame) -> DataFrame:
    """(chunk_id, ref_count) of every chunk, zero included."""
    counts = subscribed.groupBy("chunk_id").agg(F.count("*").alias("n"))
    return chunks.select("chunk_id").distinct().join(counts, "chunk_id", "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("ref_count"))


def adjusted(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Reference counts after bulk increments and decrements (chunk_id, delta), never below zero, and who fell to zero now."""
    change = deltas.groupBy("chunk_id").agg(F.sum("delta").alias("delta"))
    after = F.greatest(F.lit(0), F.col("ref_count") + F.coalesce("delta", F.lit(0)))
    joined = counts.join(change, "chunk_id", "left")
    return joined.select("chunk_id", after.alias("ref_count"), ((after == 0) & (F.col("ref_count") > 0)).alias("orphaned"))


def cascade(subscribed: DataFrame, purged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subscriptions that are left after files (id) are purged, and ids of the chunks that nothing refers to any more."""
    gone = purged.select(F.col("id").alias("file_id"))
    left = subscribed.join(gone, "file_id", "left_anti")
    lost = subscribed.join(gone, "file_id", "left_semi").select("chunk_id").distinct()
    return left, lost.join(left.select("chunk_id"), "chunk_id", "left_anti")


def reindex(chunks_per_file: DataFrame, changed_per_file: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(file_id, reindex): whether at least ``threshold`` of a file's chunks changed; true for a file without chunks."""
    both = chunks_per_file.join(changed_per_file, "file_id", "full_outer")
    total, changed = F.coalesce("chunks", F.lit(0)), F.coalesce("changed", F.lit(0))
    return both.select("file_id", F.when(total == 0, True).otherwise(changed / total >= threshold).alias("reindex"))


def journal_since(journal: DataFrame, since, time: str = "ts") -> DataFrame:
    return journal.where(F.col(time) > F.lit(since)).orderBy(time)


def lease(queue: DataFrame, now: float, n: int, hold: float = 300.0) -> DataFrame:
    """The next ``n`` unlocked items, locked until ``now + hold`` with one attempt more: by priority, then age, then id."""
    free = queue.where(F.col("locked_until") < now).orderBy(F.desc("priority"), "created_at", "id").limit(n)
    return free.withColumn("locked_until", F.lit(now + hold)).withColumn("attempts", F.col("attempts") + 1)


def acknowledge(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("id"), "id", "left_anti")


def give_back(queue: DataFrame, failed: DataFrame, now: float, after: float = 30.0) -> DataFrame:
    """The queue with the failed items free again ``after`` seconds from ``now``."""
    marked = queue.join(failed.select("id", F.lit(True).alias("_failed")), "id", "left")
    return marked.withColumn("locked_until", F.when(F.col("_failed"), F.lit(now + after)).otherwise(F.col("locked_until"))).drop("_failed")


def dead_letters(attempts: DataFrame, most: int = 3, keep: int = 1000) -> DataFrame:
    """The newest ``keep`` items whose failures exhausted their retries (``keep`` is the feature: a bounded report)."""
    failed = attempts.groupBy("id").agg(F.count("*").alias("failures"), F.max("seq").alias("seq"), F.max_by("error", "seq").alias("error"))
    return failed.where(F.col("failures") > most).orderBy(F.desc("seq")).limit(keep)


def copies(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, copies): every row with the class of equal texts it belongs to; null texts are no copies."""
    hashed = rows.where(F.col(text).isNotNull()).select(key, F.sha2(text, 256).alias("_h"))
    groups = hashed.groupBy("_h").agg(F.min(key).alias("class_id"), F.count("*").alias("copies"))
    return hashed.join(groups, "_h").select(key, "class_id", "copies")


def fresh_by_batch(arriving: DataFrame, history: DataFrame, batch: str, key: str) -> DataFrame:
    """(batch, arrived, fresh): the different keys that arrive in each batch, and how many of them are in it first and not in the history."""
    each = arriving.groupBy(key, batch).agg(F.lit(1).alias("_one"))
    first = each.groupBy(key).agg(F.min(batch).alias("_first")).join(history.select(key).distinct().withColumn("_old", F.lit(True)), key, "left")
    marked = each.join(first, key).withColumn("_fresh", (F.col(batch) == F.col("_first")) & F.col("_old").isNull())
    return marked.groupBy(batch).agg(F.count("*").alias("arrived"), F.count_if("_fresh").alias("fresh"))


def last_delivery(rows: DataFrame, key: str, batch: str) -> DataFrame:
    """The rows of each key's last batch."""
    last = rows.groupBy(key).agg(F.max(batch).alias(batch))
    return rows.join(last, [key, batch], "left_semi")


def purged(gone: DataFrame, subscribed: DataFrame, vectors: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """(file_id, subscriptions, vectors, chunks, links) that go with each purged file (file_id); a chunk goes if no file that stays holds it.

    ``vectors``: (file_id, id); ``chunks``: (chunk_id, id); ``links``: (id) of chunks in the entity graph, one row a link.
    """
    mine = subscribed.join(gone, "file_id", "left_semi")
    kept = subscribed.join(gone, "file_id", "left_anti").select("chunk_id").distinct()
    lost = mine.join(kept, "chunk_id", "left_anti").join(chunks, "chunk_id").select("file_id", "id")
    of_graph = lost.join(links.groupBy("id").agg(F.count("*").alias("n")), "id").groupBy("file_id").agg(F.sum("n").alias("links"))
    out = gone.distinct()
    for rows, name in ((mine, "subscriptions"), (vectors.join(gone, "file_id", "left_semi"), "vectors"), (lost, "chunks")):
        out = out.join(rows.groupBy("file_id").agg(F.count("*").alias(name)), "file_id", "left")
    out = out.join(of_graph, "file_id", "left")
    return out.select("file_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("subscriptions", "vectors", "chunks", "links")))


def pending(chunks: DataFrame, done: str, order: str) -> DataFrame:
    """Chunks on which a step (its time in ``done``) is still due, the oldest first."""
    return chunks.where(F.col(done).isNull()).sort(order)
