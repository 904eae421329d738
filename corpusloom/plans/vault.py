"""Queries across the stores of a vault: what a delivery changes, what a purge takes along, hits with their files, graph context."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.workspace import materialise, scratch_path
from corpusloom.operators import context, search
from corpusloom.operators import store as S
from corpusloom.plans import graph, store
from corpusloom.plans.files import LATEST, current
from corpusloom.plans.graph import _ENT, _REL
from corpusloom.sources.tables import table


def ingest_changed(spark, d):
    """Per batch: the chunks that arrive and those that neither the history nor an earlier batch holds."""
    arriving = store.arrivals(spark, d).select("batch_no", F.lower("fingerprint").alias("f")).where("f <> ''")
    return S.fresh_by_batch(arriving, table(spark, d, "chunks").select(F.lower("fingerprint").alias("f")), "batch_no", "f")


def ingest_subscriptions(spark, d):
    """What files hold after their last delivery: it replaces the ones before."""
    rows = store.arrivals(spark, d).select("file_id", "batch_no", F.lower("fingerprint").alias("chunk_id"), F.col("chunk_seq").alias("sequence")).where("file_id is not null and chunk_id <> ''")
    return S.last_delivery(rows, "file_id", "batch_no").groupBy("file_id", "chunk_id").agg(F.max("sequence").alias("sequence"))


def purge_counts(spark, d):
    """Per tombstone: the subscriptions, vectors, chunks that nothing else refers to and entity links of these that go with it."""
    gone = current(spark, d).where("status = 'tombstone'").select(F.col("id").alias("file_id"))
    vectors = table(spark, d, "chunk_vectors").select("file_id", "id").distinct()
    held = store.accepted(spark, d).select(F.col("fingerprint").alias("chunk_id"), "id")
    links = graph.linked(spark, d).select("chunk_id").withColumnRenamed("chunk_id", "id")
    return S.purged(gone, store.subscribed(spark, d), vectors, held, links)


def pending_extraction(spark, d):
    """Chunks that no entities have been extracted from yet, the oldest first."""
    return S.pending(table(spark, d, "chunks"), "graph_extracted_at", "chunk_rowid").select("chunk_rowid", "id")


def files_metadata(spark, d):
    """The fields of the JSON that parsers left with each file."""
    data = F.try_parse_json("metadata")
    fields = [F.try_variant_get(data, f"$.{n}", t).alias(n) for n, t in (("extension", "string"), ("line_count", "bigint"), ("platform", "string"))]
    return current(spark, d).select("id", *fields)


def chunk_hits(spark, d):
    """Keyword hits over chunks with the files that hold them: a hit has a row per file, and one without where none does."""
    chunks = store.accepted(spark, d).select(F.col("fingerprint").alias("chunk_id"), "content")
    index = search.Index(spark, scratch_path(spark, "index"), "chunk_id", "string").add(chunks.select("chunk_id", search.folded_tokens(F.col("content")).alias("tokens")))
    hits = index.search([["lantern"]]).select("chunk_id", F.round("score", 6).alias("score"))
    return context.with_files(hits, store.subscribed(spark, d), current(spark, d))


def queries_with_entities(spark, d):
    asked = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return context.named_in(asked, "doc_id", "text", graph.parts(spark, d)[1].select("id", "name"))


def query_entities(spark, d):
    """The entities that are named, word by word, in each document as a query."""
    return queries_with_entities(spark, d).select("doc_id", F.col("id").alias("entity_id"))


def graph_context(spark, d):
    """How many entities lie within two hops of those that each document names, by distance."""
    edges = materialise(graph.relation_upsert(spark, d), "edges")
    return context.counts_around(materialise(queries_with_entities(spark, d), "named"), "doc_id", edges, 2)


def entity_counts(spark, d):
    return graph.parts(spark, d)[1].groupBy("entity_type").agg(F.count("*").alias("n"))


def journal_high_water(spark, d):
    """The last event of each type."""
    return table(spark, d, "events").groupBy("event_type").agg(F.max("event_id").alias("last_id"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"), F.count("*").alias("entries"))


_BATCH = "arr AS (SELECT DISTINCT * EXCLUDE arrived_at FROM chunk_batches)"
_TOKENS = r"regexp_extract_all(lower(strip_accents(coalesce({}, ''))), '[\p{{L}}\p{{Nd}}]+')"
_NAMED = f"""said AS (SELECT DISTINCT doc_id, id FROM (SELECT doc_id, ' ' || array_to_string({_TOKENS.format('text')}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL)
 JOIN (SELECT id, array_to_string({_TOKENS.format('name')}, ' ') AS n FROM ent) ON n <> '' AND contains(t, ' ' || n || ' '))"""

QUERIES = {
    "ingest_changed": (
        ingest_changed,
        f"""WITH {_BATCH}, f AS (SELECT DISTINCT batch_no, lower(fingerprint) AS f FROM arr WHERE fingerprint <> ''), firsts AS (SELECT f, min(batch_no) AS batch_no FROM f GROUP BY f)
        SELECT f.batch_no, count(*) AS arrived, count(*) FILTER (firsts.batch_no = f.batch_no AND f.f NOT IN (SELECT lower(fingerprint) FROM chunks WHERE fingerprint IS NOT NULL)) AS fresh FROM f JOIN firsts USING (f) GROUP BY 1""",
    ),
    "ingest_subscriptions": (
        ingest_subscriptions,
        f"""WITH {_BATCH}, r AS (SELECT file_id, batch_no, lower(fingerprint) AS chunk_id, chunk_seq FROM arr WHERE file_id IS NOT NULL AND fingerprint <> '')
        SELECT file_id, chunk_id, max(chunk_seq) AS sequence FROM r WHERE batch_no = (SELECT max(batch_no) FROM r q WHERE q.file_id = r.file_id) GROUP BY 1, 2""",
    ),
    "purge_counts": (
        purge_counts,
        f"""WITH {store._ALL}, {store._SUB}, {LATEST}, {graph._ENT}, {graph._LINK}, t AS (SELECT id AS file_id FROM latest WHERE status = 'tombstone'),
        kept AS (SELECT DISTINCT chunk_id FROM sub ANTI JOIN t USING (file_id)), lost AS (SELECT sub.file_id, acc.id FROM sub SEMI JOIN t USING (file_id) JOIN acc ON acc.fingerprint = sub.chunk_id WHERE sub.chunk_id NOT IN (SELECT chunk_id FROM kept)),
        v AS (SELECT file_id, count(DISTINCT id) AS n FROM chunk_vectors GROUP BY 1)
        SELECT t.file_id, (SELECT count(*) FROM sub WHERE sub.file_id = t.file_id) AS subscriptions, coalesce(v.n, 0) AS vectors, (SELECT count(*) FROM lost WHERE lost.file_id = t.file_id) AS chunks,
        (SELECT count(*) FROM lost JOIN link ON lost.id = link.chunk_id WHERE lost.file_id = t.file_id) AS links FROM t LEFT JOIN v ON v.file_id = t.file_id""",
    ),
    "pending_extraction": (pending_extraction, "SELECT chunk_rowid, id FROM chunks WHERE graph_extracted_at IS NULL"),
    "files_metadata": (
        files_metadata,
        f"WITH {LATEST} SELECT id, json_extract_string(metadata, '$.extension') AS extension, CAST(json_extract_string(metadata, '$.line_count') AS BIGINT) AS line_count, json_extract_string(metadata, '$.platform') AS platform FROM latest",
    ),
    "chunk_hits": (
        chunk_hits,
        f"""WITH {store._ALL}, {store._SUB}, {LATEST}, tok AS (SELECT fingerprint AS chunk_id, {_TOKENS.format('content')} AS k FROM acc), st AS (SELECT count(*) AS n, avg(len(k)) AS a FROM tok),
        h AS (SELECT chunk_id, len(k) AS dl, len(list_filter(k, lambda x: x = 'lantern')) AS tf FROM tok WHERE list_contains(k, 'lantern')), c AS (SELECT count(*) AS df FROM h)
        SELECT h.chunk_id, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score, sub.file_id, sub.sequence, latest.path
        FROM h CROSS JOIN c CROSS JOIN st LEFT JOIN sub ON h.chunk_id = sub.chunk_id LEFT JOIN latest ON sub.file_id = latest.id""",
    ),
    "query_entities": (query_entities, f"WITH {_ENT}, {_NAMED} SELECT doc_id, id AS entity_id FROM said"),
    "graph_context": (
        graph_context,
        f"""WITH {_REL}, {_NAMED}, one AS (SELECT DISTINCT doc_id, dst AS id, 1 AS hop FROM said JOIN both_ways ON id = src), two AS (SELECT DISTINCT doc_id, dst AS id, 2 AS hop FROM one JOIN both_ways ON id = src)
        SELECT doc_id, hop, count(*) AS entities FROM (SELECT doc_id, id, min(hop) AS hop FROM (FROM one UNION ALL FROM two) u WHERE NOT EXISTS (FROM said WHERE said.doc_id = u.doc_id AND said.id = u.id) GROUP BY 1, 2) GROUP BY 1, 2""",
    ),
    "entity_counts": (entity_counts, f"WITH {_ENT} SELECT entity_type, count(*) AS n FROM ent GROUP BY 1"),
    "journal_high_water": (journal_high_water, "SELECT event_type, max(event_id) AS last_id, max(epoch_us(ts)) AS last_us, count(*) AS entries FROM events GROUP BY 1"),
}
