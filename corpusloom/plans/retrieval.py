"""Queries of keyword, vector and hybrid retrieval, and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.workspace import path_exists, scratch_path
from corpusloom.operators import chunking, hybrid, search, vectors
from corpusloom.sources.tables import table

DIGITS = 6
K = 10


_BUILT: dict[tuple[str, str, bool], search.Index] = {}


def index_of(spark, d, stemmed=False):
    """The index of the documents, written when it is first asked for in an application; later queries read their terms from it."""
    key = spark.sparkContext.applicationId, d, stemmed
    if key not in _BUILT or not path_exists(spark, _BUILT[key].path):
        docs = table(spark, d, "documents")
        tokens = search.stemmed_tokens(docs, "doc_id", "text") if stemmed else docs.select("doc_id", search.folded_tokens(F.col("text")).alias("tokens"))
        _BUILT[key] = search.Index(spark, scratch_path(spark, "index")).add(tokens)
    return _BUILT[key]


def _rounded(hits):
    return hits.select("doc_id", F.round("score", DIGITS).alias("score"))


def postings_build(spark, d):
    """The index itself: every term of every document with how often and where first it occurs."""
    return index_of(spark, d).postings.select("term", "doc_id", "tf", (F.col("positions")[0] + 1).cast("long").alias("first"))


def postings_extended(spark, d):
    """An index of two batches of documents answers as one of all."""
    docs = table(spark, d, "documents").select("doc_id", search.folded_tokens(F.col("text")).alias("tokens"))
    both = search.Index(spark, scratch_path(spark, "index"))
    for rest in (0, 1):
        both.add(docs.where(F.col("doc_id") % 2 == rest))
    return _rounded(both.search([["bridge"], ["lantern"]]))


def bm25_and(spark, d):
    return _rounded(index_of(spark, d).search([["lantern"], ["harbour"]]))


def bm25_phrase(spark, d):
    return _rounded(index_of(spark, d).search([["gone", "missing"], ["ledger"]]))


def bm25_porter(spark, d):
    return _rounded(index_of(spark, d, stemmed=True).search(search.query_phrases("missing lanterns", stemmed=True)))


def snippets(spark, d):
    phrases = search.query_phrases("missing lanterns", stemmed=True)
    hits = index_of(spark, d, stemmed=True).search(phrases)
    return search.with_snippets(hits.select("doc_id"), table(spark, d, "documents"), "doc_id", "text", phrases)


def term_statistics(spark, d):
    return index_of(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_vector(spark, d):
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


def _near(df):
    return df.withColumn("distance", F.round("distance", DIGITS))


def knn_l2(spark, d):
    return _near(vectors.nearest(table(spark, d, "embeddings"), query_vector(spark, d), K))


def knn_filtered(spark, d):
    return _near(vectors.nearest(table(spark, d, "embeddings"), query_vector(spark, d), K, where=F.col("label") == 3))


def knn_queries(spark, d):
    rows = table(spark, d, "embeddings")
    return _near(vectors.nearest_of_each(rows.where("vec_id % 50 = 0"), rows, K, 64))


def vector_delete(spark, d):
    rows = table(spark, d, "embeddings")
    return vectors.without(rows, rows.where("label = 0"), "vec_id").groupBy("label").agg(F.count("*").alias("n"))


def vector_guard(spark, d):
    usable = vectors.storable(table(spark, d, "chunk_vectors"), "embedding", 64)
    return usable.groupBy("file_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def intent_route(spark, d):
    rows = table(spark, d, "chatgpt_conversations").select("conv_id", "title").distinct()
    return rows.select("conv_id", "title", hybrid.intent(F.col("title")).alias("lane"))


def legs(spark, d):
    ranked = lambda df, by: df.withColumn("rank", F.row_number().over(_order(by, "doc_id")))
    near = _near(vectors.nearest(table(spark, d, "embeddings"), query_vector(spark, d), 50)).select(F.col("vec_id").alias("doc_id"), F.col("distance").alias("score"))
    found = _rounded(index_of(spark, d).search([["lantern"]])).orderBy("score", "doc_id").limit(50)
    return ranked(near, "score"), ranked(found, "score")


def _order(*by):
    from pyspark.sql import Window

    return Window.orderBy(*by)  # over the 50 rows of a leg


def rrf_fuse(spark, d):
    return hybrid.fuse(*legs(spark, d), "doc_id").select("doc_id", "vector_score", "keyword_score", F.round("rrf", 9).alias("rrf"))


def hybrid_top(spark, d):
    return hybrid.top(hybrid.fuse(*legs(spark, d), "doc_id"), 20).select("doc_id", F.round("rrf", 9).alias("rrf"))


def cdc_chunks(spark, d):
    return chunking.chunks(table(spark, d, "documents")).select("doc_id", "sequence", "byte_offset", "byte_length", "fingerprint")


def chunk_sharing(spark, d):
    made = chunking.chunks(table(spark, d, "documents"))
    return made.groupBy("fingerprint").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("documents"), F.max("byte_length").alias("chars"))


def text_fingerprints(spark, d):
    return chunking.fingerprints(table(spark, d, "documents"), "doc_id", "text")


_TOK = r"regexp_extract_all(regexp_replace(lower(strip_accents(coalesce(text, ''))), '\p{M}+', '', 'g'), '[\p{L}\p{Nd}]+')"
_POST = f"""post AS (SELECT doc_id, t AS term, pos FROM (SELECT doc_id, unnest(k) AS t, generate_subscripts(k, 1) AS pos FROM (SELECT doc_id, {_TOK} AS k FROM documents))),
 len AS (SELECT doc_id, len({_TOK}) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len)"""
_SCORE = """dfs AS (SELECT phrase, count(*) AS df FROM hits GROUP BY phrase),
 scored AS (SELECT doc_id, count(*) AS c, -sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM hits JOIN dfs USING (phrase) JOIN len USING (doc_id), st GROUP BY doc_id)"""
_ONE = "SELECT doc_id, {i} AS phrase, count(*) AS tf FROM post WHERE term = '{t}' GROUP BY doc_id"
_TWO = "SELECT a.doc_id, {i} AS phrase, count(*) AS tf FROM post a JOIN post b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = '{t}' AND b.term = '{u}' GROUP BY a.doc_id"
_DIST = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6)"
_ZERO = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_LEGS = f"""WITH {_POST}, hits AS ({_ONE.format(i=0, t="lantern")}), {_SCORE},
 w AS (SELECT doc_id, score, row_number() OVER (ORDER BY score, doc_id) AS rank FROM (SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY 2, 1 LIMIT 50)),
 v AS (SELECT doc_id, score, row_number() OVER (ORDER BY score, doc_id) AS rank FROM (SELECT e.vec_id AS doc_id, {_DIST} AS score FROM embeddings e, {_ZERO} ORDER BY 2, 1 LIMIT 50)),
 f AS (SELECT doc_id, coalesce(v.score, 0.0) AS vector_score, coalesce(w.score, 0.0) AS keyword_score, round(coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + w.rank), 0), 9) AS rrf,
 CASE WHEN v.rank IS NULL THEN 1000 + w.rank ELSE v.rank END AS tie FROM v FULL JOIN w USING (doc_id))"""
_WORDS = "[" + ", ".join("'{}'".format(w) for w in hybrid.GLOBAL_TERMS) + "]", "[" + ", ".join("'{}'".format(w) for w in hybrid.MULTI_HOP_TERMS) + "]"

QUERIES = {
    "bm25_and": (bm25_and, f"WITH {_POST}, hits AS ({_ONE.format(i=0, t='lantern')} UNION ALL {_ONE.format(i=1, t='harbour')}), {_SCORE} SELECT doc_id, round(score, 6) AS score FROM scored WHERE c = 2"),
    "postings_build": (postings_build, f"WITH {_POST} SELECT term, doc_id, count(*) AS tf, min(pos) AS first FROM post GROUP BY term, doc_id"),
    "postings_extended": (postings_extended, f"WITH {_POST}, hits AS ({_ONE.format(i=0, t='bridge')} UNION ALL {_ONE.format(i=1, t='lantern')}), {_SCORE} SELECT doc_id, round(score, 6) AS score FROM scored WHERE c = 2"),
    "bm25_phrase": (bm25_phrase, f"WITH {_POST}, hits AS ({_TWO.format(i=0, t='gone', u='missing')} UNION ALL {_ONE.format(i=1, t='ledger')}), {_SCORE} SELECT doc_id, round(score, 6) AS score FROM scored WHERE c = 2"),
    "bm25_porter": (bm25_porter, None),
    "snippets": (snippets, None),
    "term_statistics": (term_statistics, f"WITH {_POST} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM post GROUP BY term"),
    "knn_l2": (knn_l2, f"SELECT e.vec_id, {_DIST} AS distance FROM embeddings e, {_ZERO} ORDER BY 2, 1 LIMIT 10"),
    "knn_filtered": (knn_filtered, f"SELECT e.vec_id, {_DIST} AS distance FROM embeddings e, {_ZERO} WHERE e.label = 3 ORDER BY 2, 1 LIMIT 10"),
    "knn_queries": (
        knn_queries,
        f"""SELECT query_id, vec_id, distance, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_DIST} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST.replace("round(", "(").replace(", 6)", ")")}, e.vec_id) AS rank
        FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) WHERE rank <= 10""",
    ),
    "vector_delete": (vector_delete, "SELECT label, count(*) AS n FROM embeddings WHERE label <> 0 OR label IS NULL GROUP BY label"),
    "vector_guard": (vector_guard, "SELECT file_id, count(*) AS n, count(DISTINCT id) AS ids FROM chunk_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY file_id"),
    "intent_route": (
        intent_route,
        f"""SELECT DISTINCT conv_id, title, CASE WHEN list_has_any(t, {_WORDS[0]}) THEN 'global_theme' WHEN list_has_any(t, {_WORDS[1]}) THEN 'multi_hop' ELSE 'specific' END AS lane
        FROM (SELECT conv_id, title, list_transform(regexp_extract_all(coalesce(title, ''), '[A-Za-z][A-Za-z\\-]*'), lambda x: lower(x)) AS t FROM chatgpt_conversations)""",
    ),
    "rrf_fuse": (rrf_fuse, f"{_LEGS} SELECT doc_id, vector_score, keyword_score, rrf FROM f"),
    "hybrid_top": (hybrid_top, f"{_LEGS} SELECT doc_id, rrf FROM f ORDER BY rrf DESC, tie LIMIT 20"),
    "cdc_chunks": (cdc_chunks, None),
    "chunk_sharing": (chunk_sharing, None),
    "text_fingerprints": (text_fingerprints, None),
}
