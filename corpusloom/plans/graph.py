"""Queries over the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.workspace import materialise
from corpusloom.operators import graph as O
from corpusloom.sources.tables import table


def extracted(spark, d):
    return table(spark, d, "extractions")


def entity_upsert(spark, d):
    return O.upsert_entities(extracted(spark, d)).select("id", "name", "entity_type")


def relation_upsert(spark, d):
    return O.upsert_relations(extracted(spark, d), O.upsert_entities(extracted(spark, d)))


def entity_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(O.spotted_entities(F.col("text")), "|").alias("entities"))


def cooccurrence(spark, d):
    found = table(spark, d, "documents").select(F.explode(O.chained(O.spotted_entities(F.col("text")))).alias("e"))
    return found.groupBy("e.source", "e.target").agg(F.count("*").alias("n"), F.max("e.weight").alias("weight"))


def neighbourhood(spark, d):
    """Two hops around a stated query set: every entity whose id, read as a number, is divisible by 50, against all edges."""
    edges = materialise(relation_upsert(spark, d), "edges")
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return O.neighbourhood(edges, ends.where(F.conv(F.substring("id", 5, 6), 16, 10).cast("long") % 50 == 0), 2)


def linked(spark, d, condition="true"):
    held = table(spark, d, "chunks").where(condition).select(F.col("id").alias("chunk_id"))
    rows = extracted(spark, d).select("chunk_id", F.explode("entities").alias("e")).join(held, "chunk_id", "left_semi")
    return rows.select(O.entity_id(F.col("e.name"), F.coalesce("e.entity_type", F.lit("Concept"))).alias("id"), "chunk_id").distinct()


def orphan_entities(spark, d):
    """Entities that only chunks which nothing refers to any more are linked to."""
    return O.orphans(O.upsert_entities(extracted(spark, d)), linked(spark, d, "ref_count > 0 and graph_extracted_at is not null")).select("id")


def entity_links(spark, d):
    return linked(spark, d).groupBy("id").agg(F.count("*").alias("chunks"))


def parts(spark, d):
    return relation_upsert(spark, d), O.upsert_entities(extracted(spark, d))


def graph_components(spark, d):
    edges, nodes = parts(spark, d)
    return O.components(nodes.select("id"), edges)


def graph_communities(spark, d):
    edges, nodes = parts(spark, d)
    return O.community_rows(nodes.select("id"), edges)


def community_summaries(spark, d):
    edges, nodes = parts(spark, d)
    return O.summaries(O.largest(materialise(O.community_rows(nodes.select("id"), edges), "communities")), nodes)


_ENT = """raw AS (SELECT extracted_at, chunk_id, e, pos FROM (SELECT extracted_at, chunk_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS pos FROM extractions)),
 named AS (SELECT 'ent_' || substr(sha1(lower(coalesce(e.entity_type, 'Concept')) || '::' || lower(trim(e.name))), 1, 16) AS id, e.name AS name, coalesce(e.entity_type, 'Concept') AS entity_type, coalesce(e.description, '') AS description, extracted_at, chunk_id, pos
 FROM raw WHERE trim(e.name) <> ''),
 ent AS (SELECT id, name, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY extracted_at DESC NULLS LAST, chunk_id DESC NULLS LAST, pos DESC, name DESC, entity_type DESC, description DESC) AS rn FROM named) WHERE rn = 1)"""
_REL = f"""{_ENT}, keys AS (SELECT lower(trim(name)) AS key, min(id) AS id FROM ent GROUP BY 1),
 rr AS (SELECT extracted_at, chunk_id, pos, lower(trim(r.source)) AS s, lower(trim(r.target)) AS t, coalesce(nullif(r.weight, 0), 1.0) AS weight FROM (SELECT extracted_at, chunk_id, unnest(relations) AS r, generate_subscripts(relations, 1) AS pos FROM extractions)),
 edge AS (SELECT src, dst, weight FROM (SELECT a.id AS src, b.id AS dst, weight, row_number() OVER (PARTITION BY a.id, b.id ORDER BY extracted_at DESC NULLS LAST, chunk_id DESC NULLS LAST, pos DESC, weight DESC) AS rn
 FROM rr JOIN keys a ON s = a.key JOIN keys b ON t = b.key WHERE a.id <> b.id) WHERE rn = 1),
 both_ways AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge)"""
_STOP = "(" + ", ".join(f"'{w}'" for w in O.STOPWORDS) + ")"
# DuckDB's word boundaries are those of ASCII: other letters, digits and marks become "_", which is a word character, and other signs "~", which is none; the runs themselves are ASCII.
_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{0085}\p{Zs}\p{Zl}\p{Zp}]', ' ', 'g'), '[\p{Lo}\p{Lm}\p{M}\p{Nl}\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02FF}\x{0370}-\x{1FFF}]', '_', 'g'), '[^\x00-\x7F]', '~', 'g')"
_SPOT = rf"""runs AS (SELECT doc_id, list_filter(regexp_extract_all({_PLAIN}, '\b[A-Z][a-zA-Z]{{3,}}(?:\s+[A-Z][a-zA-Z]+){{0,2}}\b'), lambda r: regexp_extract(r, '^(\S+)', 1) NOT IN {_STOP}) AS r FROM documents),
 spot AS (SELECT doc_id, (list_filter(r, lambda x, i: list_position(list_transform(r, lambda y: lower(y)), lower(x)) = i))[1:5] AS e FROM runs)"""
_LINK = "link AS (SELECT DISTINCT 'ent_' || substr(sha1(lower(coalesce(e.entity_type, 'Concept')) || '::' || lower(trim(e.name))), 1, 16) AS id, chunk_id FROM raw SEMI JOIN (SELECT id AS chunk_id FROM chunks) USING (chunk_id) WHERE e.name IS NOT NULL)"

QUERIES = {
    "entity_upsert": (entity_upsert, f"WITH {_ENT} SELECT * FROM ent"),
    "relation_upsert": (relation_upsert, f"WITH {_REL} SELECT src, dst, weight FROM edge"),
    "entity_extract": (entity_extract, f"WITH {_SPOT} SELECT doc_id, coalesce(array_to_string(e, '|'), '') AS entities FROM spot"),
    "cooccurrence": (
        cooccurrence,
        f"""WITH {_SPOT} SELECT source, target, count(*) AS n, 0.5::DOUBLE AS weight FROM (SELECT e[i] AS source, e[i + 1] AS target FROM (SELECT e, unnest(range(1, len(e))) AS i FROM spot)) GROUP BY 1, 2""",
    ),
    "neighbourhood": (
        neighbourhood,
        f"""WITH RECURSIVE {_REL}, seeds AS (SELECT DISTINCT src AS id FROM both_ways WHERE CAST('0x' || substr(src, 5, 6) AS BIGINT) % 50 = 0), walk AS (SELECT id AS seed, id, 0 AS hop FROM seeds UNION SELECT seed, dst, hop + 1 FROM walk JOIN both_ways ON id = src WHERE hop < 2)
        SELECT seed, id, min(hop) AS hop FROM walk WHERE seed <> id GROUP BY 1, 2""",
    ),
    "orphan_entities": (orphan_entities, f"WITH {_ENT}, {_LINK.replace('FROM chunks', 'FROM chunks WHERE ref_count > 0 AND graph_extracted_at IS NOT NULL')} SELECT id FROM ent WHERE entity_type <> 'Summary' AND id NOT IN (SELECT id FROM link)"),
    "entity_links": (entity_links, f"WITH {_ENT}, {_LINK} SELECT id, count(*) AS chunks FROM link GROUP BY id"),
    "graph_components": (
        graph_components,
        f"""WITH RECURSIVE {_REL}, reach AS (SELECT id AS a, id AS b FROM ent UNION SELECT a, dst FROM reach JOIN both_ways ON b = src) SELECT a AS id, min(b) AS component FROM reach GROUP BY a""",
    ),
    "graph_communities": (graph_communities, None),
    "community_summaries": (community_summaries, None),
}
