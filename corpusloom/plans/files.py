"""Queries over the file table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import files as O
from corpusloom.sources.tables import table

LATEST = "latest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM files WHERE id IS NOT NULL) WHERE rn = 1)"
EXT = r"regexp_extract(lower(path), '(\.[^./]*)$', 1)"


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def current(spark, d):
    return O.latest(table(spark, d, "files"))


def list_files(spark, d):
    return O.list_files(current(spark, d)).select("id", "path", "status", "size", "updated_at")


def files_by_status(spark, d):
    return current(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def page_files(spark, d):
    return O.page(O.list_files(current(spark, d)), [F.desc("updated_at"), F.col("id")], 50, 20).select("id", "path", "updated_at")


def scope_gate(spark, d):
    gate = O.allowed(F.col("path"), roots=["/vault"], blocked=[".pdf", ".key", ".env"], exclude=["*/archive/*", "*.tmp"])
    return current(spark, d).select("id", gate.alias("allowed"))


def size_gate(spark, d):
    return current(spark, d).select("id", "size", O.within_size(F.col("size"), 10_000).alias("allowed"))


def classify_files(spark, d):
    media = O.media_type(F.col("path"))
    return current(spark, d).select("id", O.lane(F.col("path")).alias("lane"), media.alias("media_type"), O.parser_of(F.col("path"), media).alias("parser"))


def change_detect(spark, d):
    rows = table(spark, d, "files").distinct()
    before = F.lag(F.struct(*O.IDENTITY)).over(_versions())
    pairs = rows.select("id", "updated_at", F.struct(*O.IDENTITY).alias("new"), before.alias("old"))
    return pairs.select("id", "updated_at", (F.col("old").isNull() | O.has_changed("new", "old")).alias("changed"))


def _versions():
    from pyspark.sql import Window

    return Window.partitionBy("id").orderBy("updated_at")


def drift_detect(spark, d):
    files = table(spark, d, "files")
    listing = files.where("status in ('indexed', 'pending')").groupBy("path").agg(F.min("mtime").alias("mtime"), F.min("size").alias("size"))
    return O.drift(O.latest(files), listing)


def physical_files(spark, d):
    return O.physical_classes(current(spark, d))


def purge_tombstones(spark, d):
    now = table(spark, d, "files").agg(F.max("updated_at")).first()[0] or 0.0
    return O.purgeable(current(spark, d), now, 30).select("id", "path", "deleted_at")


_MEDIA = "CASE " + " ".join(f"WHEN {EXT} = '{e}' THEN '{m}'" for e, m in O.MEDIA_TYPES.items()) + " ELSE 'application/octet-stream' END"
_LANE = f"""CASE WHEN lower(path) LIKE '%.tar.gz' OR lower(path) LIKE '%.tar.bz2' OR lower(path) LIKE '%.tar.xz' THEN 'background'
 WHEN {EXT} IN {_in(O.FAST)} THEN 'fast' WHEN {EXT} IN {_in(O.HEAVY)} THEN 'heavy' WHEN {EXT} IN {_in(O.BACKGROUND)} THEN 'background' ELSE 'heavy' END"""
_PARSER = f"""CASE WHEN regexp_extract(lower(path), '([^/]*)$', 1) LIKE '%conversations.json' OR (lower(path) LIKE '%chatgpt%' AND {EXT} = '.zip') THEN 'chatgpt'
 WHEN lower(path) LIKE '%claude%' AND {EXT} IN ('.json', '.zip') THEN 'claude'
 WHEN (lower(path) LIKE '%gemini%' OR lower(path) LIKE '%bard%') AND {EXT} IN ('.json', '.zip', '.html') THEN 'gemini'
 WHEN lower(path) LIKE '%takeout%' AND {EXT} = '.zip' THEN 'gemini'
 WHEN (regexp_matches(lower(path), 'copilot|microsoft|bing') AND {EXT} IN ('.json', '.csv', '.md')) OR (lower(path) LIKE '%perplexity%' AND {EXT} IN ('.json', '.md')) THEN 'ai_generic'
 WHEN media = 'application/pdf' OR {EXT} = '.pdf' THEN 'pdf' WHEN {EXT} IN ('.docx', '.xlsx', '.pptx') THEN 'office'
 WHEN media LIKE 'image/%' THEN 'image' WHEN media LIKE 'audio/%' THEN 'audio' WHEN {EXT} IN ('.zip', '.tar', '.tgz', '.tar.gz') THEN 'archive'
 WHEN media LIKE 'text/%' OR media IN ('application/json', 'application/xml') OR {EXT} IN {_in(O.FAST)} THEN 'text' ELSE 'none' END"""
_SAME = " AND ".join(f"{c} IS NOT DISTINCT FROM lag({c}) OVER w" for c in O.IDENTITY)

QUERIES = {
    "list_files": (list_files, f"WITH {LATEST} SELECT id, path, status, size, updated_at FROM latest WHERE status <> 'tombstone'"),
    "files_by_status": (files_by_status, f"WITH {LATEST} SELECT status, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM latest GROUP BY status"),
    "page_files": (page_files, f"WITH {LATEST} SELECT id, path, updated_at FROM latest WHERE status <> 'tombstone' ORDER BY updated_at DESC, id LIMIT 50 OFFSET 20"),
    "scope_gate": (scope_gate, rf"WITH {LATEST} SELECT id, starts_with(path, '/vault/') AND {EXT} NOT IN ('.pdf', '.key', '.env') AND NOT regexp_matches(path, '/archive/') AND path NOT LIKE '%.tmp' AS allowed FROM latest"),
    "size_gate": (size_gate, f"WITH {LATEST} SELECT id, size, coalesce(size <= 10000, false) AS allowed FROM latest"),
    "classify_files": (classify_files, f"WITH {LATEST}, typed AS (SELECT *, {_MEDIA} AS media FROM latest) SELECT id, {_LANE} AS lane, media AS media_type, {_PARSER} AS parser FROM typed"),
    "change_detect": (change_detect, f"SELECT id, updated_at, row_number() OVER w = 1 OR NOT ({_SAME}) AS changed FROM (SELECT DISTINCT * FROM files) WINDOW w AS (PARTITION BY id ORDER BY updated_at)"),
    "drift_detect": (
        drift_detect,
        f"""WITH {LATEST}, listing AS (SELECT path, min(mtime) AS m, min(size) AS s FROM files WHERE status IN ('indexed', 'pending') GROUP BY path)
        SELECT DISTINCT path, event FROM (SELECT latest.path, CASE WHEN s IS NULL THEN 'deleted' WHEN mtime IS DISTINCT FROM m OR size IS DISTINCT FROM s THEN 'modified' END AS event
        FROM latest LEFT JOIN listing ON latest.path = listing.path WHERE status <> 'tombstone') WHERE event IS NOT NULL""",
    ),
    "physical_files": (
        physical_files,
        f"""WITH {LATEST}, g AS (SELECT inode, device, min(id) AS class_id, count(*) AS links FROM latest WHERE inode <> 0 GROUP BY inode, device)
        SELECT id, class_id, links FROM latest JOIN g USING (inode, device)""",
    ),
    "purge_tombstones": (purge_tombstones, f"WITH {LATEST} SELECT id, path, deleted_at FROM latest WHERE status = 'tombstone' AND deleted_at < (SELECT max(updated_at) FROM files) - 30 * 86400.0"),
}
