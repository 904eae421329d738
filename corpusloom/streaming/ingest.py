"""Structured Streaming: continuous ingest, settled files, debounced events, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.workspace import materialise, path_exists
from corpusloom.operators.chunking import chunks


def debounced(events: DataFrame, key: str, time: str, within: str = "1 second") -> DataFrame:
    """One event per key and stretch of ``within``: repeats are dropped while the watermark remembers the first."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def settled(sightings: DataFrame, settle_ms: int = 5000, give_up_ms: int = 60_000) -> DataFrame:
    """(path, size, settled) of files whose size stays the same for ``settle_ms`` of event time; ``settled`` is false where that
    doesn't happen within ``give_up_ms`` of the first sighting. ``sightings``: (path, size, ts)."""
    out, kept = "path string, size long, settled boolean", "first long, last long, size long"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            began, changed, size = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "size": [size], "settled": [True]})
            return
        began, changed, size = state.get if state.exists else (None, None, None)
        for pdf in batches:
            for seen, n in sorted(zip((pdf["ts"].astype("int64") // (10**3 if pdf["ts"].dtype == "datetime64[us]" else 10**6)).tolist(), pdf["size"].tolist())):
                began = seen if began is None else began
                if n != size:
                    changed, size = seen, n
        if changed - began >= give_up_ms:
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "size": [size], "settled": [False]})
            return
        state.update((began, changed, size))
        state.setTimeoutTimestamp(max(changed + settle_ms, now + 1))

    return sightings.withWatermark("ts", "0 seconds").groupBy("path").applyInPandasWithState(follow, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def committed(spark: SparkSession, vault: str, name: str, schema: str) -> DataFrame:
    """Rows of a table of the vault, with their batch, that belong to committed batches."""
    if not path_exists(spark, f"{vault}/commits") or not path_exists(spark, f"{vault}/{name}"):
        return spark.createDataFrame([], f"{schema}, batch long")
    done = spark.read.schema("batch long").parquet(f"{vault}/commits").distinct()
    return spark.read.schema(f"{schema}, batch long").parquet(f"{vault}/{name}").join(done, "batch", "left_semi").select(*(c.split()[0] for c in schema.split(", ")), "batch")


def journal(spark: SparkSession, vault: str, kind: str = "long") -> DataFrame:
    """(doc_id, chunks, content, operation, batch): every UPSERT and DELETE of a document, with the hash of its content."""
    return committed(spark, vault, "journal", f"doc_id {kind}, chunks long, content long, operation string")


def subscriptions(spark: SparkSession, vault: str, kind: str = "long") -> DataFrame:
    """(doc_id, fingerprint, sequence) of what documents hold now: those of the last batch that a document was in."""
    last = journal(spark, vault, kind).groupBy("doc_id").agg(F.max_by("operation", "batch").alias("operation"), F.max("batch").alias("batch")).where("operation = 'UPSERT'")
    return committed(spark, vault, "file_chunks", f"doc_id {kind}, fingerprint string, sequence long").join(last, ["doc_id", "batch"], "left_semi").drop("batch")


def ingest_batch(batch: DataFrame, batch_id: int, vault: str) -> None:
    """Take one micro-batch of documents (doc_id, text) into the vault: chunks that are new, what each document holds now in place of what
    it held before, and a journal entry. A null text is a deletion. Documents whose content hasn't changed are passed over.

    Everything of a batch goes below its own id and counts once the id is among the commits, which is written last; a batch
    that is tried again overwrites what it wrote.
    """
    spark, kind = batch.sparkSession, batch.schema["doc_id"].dataType.simpleString()
    rows = batch.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("content")).groupBy("doc_id").agg(F.max_by(F.struct("text", "content"), F.struct(F.col("text").isNotNull(), "content")).alias("x"))
    before = journal(spark, vault, kind).where(F.col("batch") < batch_id).groupBy("doc_id").agg(F.max_by(F.struct("content", "operation"), "batch").alias("was"))
    due = rows.join(before, "doc_id", "left").where("was is null or was.content <> x.content or (was.operation = 'UPSERT') <> (x.text is not null)").where("was is not null or x.text is not null")
    due = materialise(due.select("doc_id", "x.text", "x.content"), "due")
    made = materialise(chunks(due.select("doc_id", "text")), "made")
    fresh = made.groupBy("fingerprint").agg(F.first("content").alias("content"), F.first("byte_length").alias("byte_length"))
    known = committed(spark, vault, "chunks", "fingerprint string, content string, byte_length long").where(F.col("batch") < batch_id).select("fingerprint")
    fresh.join(known, "fingerprint", "left_anti").sortWithinPartitions("fingerprint").write.mode("overwrite").parquet(f"{vault}/chunks/batch={batch_id}")
    held = made.groupBy("doc_id", "fingerprint").agg(F.max("sequence").alias("sequence"))
    held.write.mode("overwrite").parquet(f"{vault}/file_chunks/batch={batch_id}")
    counts = made.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    entry = due.join(counts, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), "content", F.when(F.col("text").isNull(), "DELETE").otherwise("UPSERT").alias("operation"))
    entry.write.mode("overwrite").parquet(f"{vault}/journal/batch={batch_id}")
    spark.range(batch_id, batch_id + 1).toDF("batch").coalesce(1).write.mode("append").parquet(f"{vault}/commits")


def ingest(documents: DataFrame, vault: str, checkpoint: str, **trigger):
    """Start continuous ingest of a stream of documents (doc_id, text) into a vault folder."""
    return documents.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, vault)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) by event time; events later than the watermark are dropped in a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, n) of stretches of a user's events without a gap of ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), "n")
