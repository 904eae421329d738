"""Queries over chunks, subscriptions, the journal and queues. Batches stand in for what files subscribe to, events for journal and queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import store as O
from corpusloom.plans.files import LATEST, current
from corpusloom.sources.tables import table

ROWS = "chunk_rowid", "id", "content", "fingerprint", "byte_offset", "byte_length"


def arrivals(spark, d):
    return table(spark, d, "chunk_batches").drop("arrived_at").distinct()


def accepted(spark, d):
    return O.upsert_chunks(table(spark, d, "chunks").select(*ROWS).unionByName(arrivals(spark, d).select(*ROWS)))


def subscribed(spark, d):
    return O.subscriptions(arrivals(spark, d))


def alive(spark, d):
    return O.live(subscribed(spark, d), current(spark, d))


def all_chunks(spark, d):
    return accepted(spark, d).select(F.col("fingerprint").alias("chunk_id"))


def chunk_upsert(spark, d):
    return accepted(spark, d).select("id", "fingerprint", "byte_offset", "byte_length", F.length("content").cast("long").alias("chars"), "versions")


def subscriptions(spark, d):
    return subscribed(spark, d)


def chunks_of_files(spark, d):
    held = accepted(spark, d).select(F.col("fingerprint").alias("chunk_id"), F.substring("content", 1, 200).alias("preview"))
    return subscribed(spark, d).join(held, "chunk_id").select("file_id", "sequence", "chunk_id", "preview")


def chunk_counts(spark, d):
    return subscribed(spark, d).groupBy("file_id").agg(F.count("*").alias("chunks"), F.max("sequence").alias("last"))


def ref_counts(spark, d):
    return O.ref_counts(all_chunks(spark, d), alive(spark, d))


def orphan_chunks(spark, d):
    return ref_counts(spark, d).where("ref_count = 0").select("chunk_id")


def bulk_decrement(spark, d):
    every = subscribed(spark, d)
    gone = current(spark, d).where("status = 'tombstone'").select(F.col("id").alias("file_id"))
    lost = every.join(gone, "file_id", "left_semi").select("chunk_id", F.lit(-1).alias("delta"))
    return O.adjusted(O.ref_counts(all_chunks(spark, d), every), lost)


def cascade_purge(spark, d):
    return O.cascade(subscribed(spark, d), current(spark, d).where("status = 'tombstone'"))[1]


def reindex_files(spark, d):
    every = subscribed(spark, d)
    known = table(spark, d, "chunks").select(F.lower("fingerprint").alias("chunk_id"))
    changed = every.join(known, "chunk_id", "left_anti").groupBy("file_id").agg(F.count("*").alias("changed"))
    return O.reindex(every.groupBy("file_id").agg(F.count("*").alias("chunks")), changed)


def text_copies(spark, d):
    return O.copies(table(spark, d, "documents"), "doc_id", "text")


def journal_since(spark, d):
    return O.journal_since(table(spark, d, "events"), "2024-01-15 00:00:00").select("event_id", "user_id", "event_type")


def queue_depth(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("depth"))


def queue(spark, d):
    rank = F.create_map(*[F.lit(x) for pair in {"purchase": 3, "signup": 2, "error": 1}.items() for x in pair])
    created = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.coalesce(rank[F.col("event_type")], F.lit(0)).cast("long").alias("priority"), created.alias("created_at"), (created + F.col("value") * 1000).alias("locked_until"), F.lit(0).cast("long").alias("attempts")
    )


NOW = 1705276800.0


def lease_next(spark, d):
    return O.lease(queue(spark, d), NOW, 100).select("id", "priority", "locked_until", "attempts")


def queue_after(spark, d):
    every = queue(spark, d)
    leased = O.lease(every, NOW, 300)
    left = O.acknowledge(every, leased.where("priority >= 2"))
    free = O.give_back(left, leased.where("priority < 2"), NOW)
    return free.where(F.col("locked_until") <= NOW + 30).groupBy("priority").agg(F.count("*").alias("free"))


def dead_letters(spark, d):
    attempts = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("props").alias("error"))
    return O.dead_letters(attempts)


_ALL = """rowsx AS (SELECT chunk_rowid, id, content, lower(fingerprint) AS fingerprint, byte_offset, byte_length FROM chunks UNION ALL
 SELECT DISTINCT chunk_rowid, id, content, lower(fingerprint), byte_offset, byte_length FROM (SELECT DISTINCT * EXCLUDE arrived_at FROM chunk_batches)),
 acc AS (SELECT fingerprint, arg_min(id, chunk_rowid) AS id, arg_max(content, chunk_rowid) AS content, arg_max(byte_offset, chunk_rowid) AS byte_offset, arg_max(byte_length, chunk_rowid) AS byte_length, count(*) AS versions
 FROM rowsx WHERE fingerprint <> '' GROUP BY fingerprint)"""
_SUB = "sub AS (SELECT file_id, lower(fingerprint) AS chunk_id, max(chunk_seq) AS sequence FROM chunk_batches WHERE file_id IS NOT NULL AND fingerprint <> '' GROUP BY 1, 2)"
_LIVE = f"{LATEST}, live AS (SELECT sub.* FROM sub SEMI JOIN (SELECT id AS file_id FROM latest WHERE status <> 'tombstone') USING (file_id))"
_REFS = "refs AS (SELECT fingerprint AS chunk_id, count(live.chunk_id) AS ref_count FROM acc LEFT JOIN live ON acc.fingerprint = live.chunk_id GROUP BY 1)"
_QUEUE = """q AS (SELECT event_id AS id, CAST(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS BIGINT) AS priority, epoch_us(ts) / 1e6 AS created_at,
 epoch_us(ts) / 1e6 + value * 1000 AS locked_until FROM events)"""

QUERIES = {
    "chunk_upsert": (chunk_upsert, f"WITH {_ALL} SELECT id, fingerprint, byte_offset, byte_length, length(content) AS chars, versions FROM acc"),
    "subscriptions": (subscriptions, f"WITH {_SUB} SELECT * FROM sub"),
    "chunks_of_files": (chunks_of_files, f"WITH {_ALL}, {_SUB} SELECT file_id, sequence, chunk_id, substr(content, 1, 200) AS preview FROM sub JOIN acc ON chunk_id = fingerprint"),
    "chunk_counts": (chunk_counts, f'WITH {_SUB} SELECT file_id, count(*) AS chunks, max(sequence) AS "last" FROM sub GROUP BY file_id'),
    "ref_counts": (ref_counts, f"WITH {_ALL}, {_SUB}, {_LIVE}, {_REFS} SELECT * FROM refs"),
    "orphan_chunks": (orphan_chunks, f"WITH {_ALL}, {_SUB}, {_LIVE}, {_REFS} SELECT chunk_id FROM refs WHERE ref_count = 0"),
    "bulk_decrement": (
        bulk_decrement,
        f"""WITH {_ALL}, {_SUB}, {LATEST}, c AS (SELECT fingerprint AS chunk_id, count(sub.chunk_id) AS n, count(t.id) AS gone FROM acc LEFT JOIN sub ON fingerprint = sub.chunk_id
        LEFT JOIN (SELECT id FROM latest WHERE status = 'tombstone') t ON sub.file_id = t.id GROUP BY 1)
        SELECT chunk_id, greatest(0, n - gone) AS ref_count, n > 0 AND n - gone <= 0 AS orphaned FROM c""",
    ),
    "cascade_purge": (
        cascade_purge,
        f"""WITH {_SUB}, {LATEST}, t AS (SELECT id AS file_id FROM latest WHERE status = 'tombstone')
        SELECT DISTINCT chunk_id FROM sub SEMI JOIN t USING (file_id) WHERE chunk_id NOT IN (SELECT chunk_id FROM sub ANTI JOIN t USING (file_id))""",
    ),
    "reindex_files": (
        reindex_files,
        f"""WITH {_SUB} SELECT file_id, count(*) FILTER (chunk_id NOT IN (SELECT lower(fingerprint) FROM chunks WHERE fingerprint IS NOT NULL)) / count(*) >= 0.2 AS reindex FROM sub GROUP BY file_id""",
    ),
    "text_copies": (text_copies, "SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS copies FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text)"),
    "journal_since": (journal_since, "SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'"),
    "queue_depth": (queue_depth, "SELECT event_type, count(*) AS depth FROM events GROUP BY event_type"),
    "lease_next": (lease_next, f"WITH {_QUEUE} SELECT id, priority, {NOW + 300} ::DOUBLE AS locked_until, CAST(1 AS BIGINT) AS attempts FROM q WHERE locked_until < {NOW} ORDER BY priority DESC, created_at, id LIMIT 100"),
    "queue_after": (
        queue_after,
        f"""WITH {_QUEUE}, l AS (SELECT id, priority FROM q WHERE locked_until < {NOW} ORDER BY priority DESC, created_at, id LIMIT 300)
        SELECT priority, count(*) AS free FROM (SELECT q.id, q.priority, CASE WHEN l.id IS NOT NULL THEN {NOW} + 30 ELSE locked_until END AS lock FROM q LEFT JOIN (SELECT id FROM l WHERE priority < 2) l ON q.id = l.id
        WHERE q.id NOT IN (SELECT id FROM l WHERE priority >= 2)) WHERE lock <= {NOW} + 30 GROUP BY priority""",
    ),
    "dead_letters": (dead_letters, "SELECT user_id AS id, count(*) AS failures, max(event_id) AS seq, arg_max(props, event_id) AS error FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 3 ORDER BY seq DESC LIMIT 1000"),
}
