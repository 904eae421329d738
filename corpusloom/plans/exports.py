"""Queries over chat exports, marked-up documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import exports as O
from corpusloom.operators.timestamps import normalise_timestamps
from corpusloom.sources import markup, parsers
from corpusloom.sources.tables import table
from corpusloom.streaming import ingest


def claude_transcripts(spark, d):
    """Conversations whose messages have positions; the rest come out of claude_transcripts_by_time."""
    return O.flat_transcripts(O.numbered(table(spark, d, "claude_messages")))


def claude_transcripts_by_time(spark, d):
    """Conversations in which a message has no position, in the order of the instants that their raw times denote."""
    rows = O.numbered(table(spark, d, "claude_messages"), yes=False)
    return O.flat_transcripts(normalise_timestamps(rows, "created_at", "client_tz", "locale"), "utc_us")


def gemini_transcripts(spark, d):
    return O.pair_transcripts(table(spark, d, "gemini_conversations"))


def chatgpt_statistics(spark, d):
    return O.tree_statistics(table(spark, d, "chatgpt_nodes"))


def claude_statistics(spark, d):
    rows = table(spark, d, "claude_messages").select("file_id", "conversation_uuid", "uuid", (F.size(F.coalesce("attachments", F.array())) > 0).alias("attached")).distinct()
    return rows.groupBy("file_id").agg(F.count_distinct("conversation_uuid").alias("conversations"), F.count("*").alias("messages"), F.bool_or("attached").alias("has_attachments"))


def gemini_statistics(spark, d):
    return gemini_transcripts(spark, d).agg(F.count("*").alias("conversations"), F.sum("messages").alias("messages"), F.max("messages").alias("longest"))


def session_transcripts(spark, d):
    """Sessions of message rows by their least position; rows without one come last, by text."""
    rows = table(spark, d, "claude_messages").withColumn("said", O.said(F.col("text"), F.col("content"))).withColumn("who", F.coalesce(F.nullif("sender", F.lit("")), "role", F.lit("unknown"))).withColumn("msg_index", F.coalesce("msg_index", F.lit(2**62)))
    return O.sessions_of_rows(rows.select("conversation_uuid", "msg_index", "who", "said", "uuid").distinct(), "conversation_uuid", "msg_index", "who", "said")


def html_pages(spark, d):
    return table(spark, d, "documents").where("text like '<%'").select("doc_id", markup.strip_html(F.col("text")).alias("plain"))


def question_counts(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", markup.question_count(text).alias("questions"), markup.answer_count(text).alias("answers"))


def cited_links(spark, d):
    links = markup.cited_links(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(links).cast("long").alias("links"), F.array_join(F.slice(links, 1, 50), " ").alias("first_links"))


def parse_documents(spark, d):
    files = table(spark, d, "documents").where("path is not null and text is not null").select("path", F.col("text").cast("binary").alias("content"))
    return parsers.parse_files(files).select("path", "parser", F.length("text").alias("chars"), "metadata")


def decode_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", markup.decoded(F.col("text").cast("binary")).alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("chars"), (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("lines"))


def tumbling_events(spark, d):
    rows = ingest.tumbling(table(spark, d, "events"))
    return rows.select((F.unix_micros(F.col("window_start").cast("timestamp"))).alias("window_us"), "event_type", "n", F.round("total", 4).alias("total"))


def session_events(spark, d):
    rows = ingest.sessions(table(spark, d, "events"))
    return rows.select("user_id", F.unix_micros(F.col("session_start").cast("timestamp")).alias("start_us"), "n")


_SAID = "coalesce(nullif(text, ''), array_to_string(content, chr(10)), '')"
_WHO = "CASE coalesce(nullif(sender, ''), nullif(role, ''), 'unknown') WHEN 'human' THEN 'User' ELSE {} END"
_RAW = "coalesce(nullif(sender, ''), nullif(role, ''), 'unknown')"
_TITLED = f"array_to_string(list_transform(string_split({_RAW}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_PIECE = "CASE WHEN instr(t, '>') <= 1 THEN '<' || t ELSE CASE WHEN regexp_extract(lower(t), '^/?([a-z0-9]+)', 1) IN ('" + "', '".join(markup.LINE_TAGS) + "') THEN chr(10) ELSE '' END || substr(t, instr(t, '>') + 1) END"
_CUT = f"string_split(regexp_replace(text, '{markup.HIDDEN_ELEMENT}', '', 'g'), '<')"
_STRIP = f"trim(regexp_replace({_CUT}[1] || array_to_string(list_transform({_CUT}[2:], lambda t: {_PIECE}), ''), '\\n\\n\\n+', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"

_PAIRS = """g AS (SELECT DISTINCT id AS conv_id, coalesce(nullif(title, ''), 'Untitled') AS title, flatten(list_transform(coalesce(messages, []), lambda m: list_filter([CASE WHEN coalesce(m.prompt, '') <> '' THEN '**User:** ' || m.prompt END,
 CASE WHEN coalesce(m.response, '') <> '' THEN '**Gemini:** ' || m.response END], lambda x: x IS NOT NULL))) AS lines FROM gemini_conversations)"""

QUERIES = {
    "claude_transcripts": (
        claude_transcripts,
        f"""WITH m AS (SELECT DISTINCT conversation_uuid AS conv_id, coalesce(nullif(conversation_name, ''), 'Untitled') AS title, msg_index, uuid, '**' || {_WHO.format(_TITLED)} || ':** ' || {_SAID} AS line FROM claude_messages ANTI JOIN (SELECT DISTINCT conversation_uuid FROM claude_messages WHERE msg_index IS NULL) USING (conversation_uuid))
        SELECT conv_id, count(*) AS messages, '# ' || max(title) || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY msg_index, uuid) || chr(10) AS transcript FROM m GROUP BY conv_id""",
    ),
    "claude_transcripts_by_time": (claude_transcripts_by_time, None),
    "gemini_transcripts": (gemini_transcripts, f"WITH {_PAIRS} SELECT conv_id, len(lines) AS messages, '# ' || title || chr(10) || chr(10) || CASE WHEN len(lines) > 0 THEN array_to_string(lines, chr(10) || chr(10)) || chr(10) ELSE '' END AS transcript FROM g"),
    "chatgpt_statistics": (
        chatgpt_statistics,
        """SELECT file_id, count(DISTINCT conv_id) AS conversations, count(*) AS nodes, coalesce(string_agg(DISTINCT model_slug, ',' ORDER BY model_slug), '') AS models FROM (SELECT DISTINCT file_id, conv_id, node_id, model_slug FROM chatgpt_nodes) GROUP BY file_id""",
    ),
    "claude_statistics": (
        claude_statistics,
        "SELECT file_id, count(DISTINCT conversation_uuid) AS conversations, count(*) AS messages, bool_or(a) AS has_attachments FROM (SELECT DISTINCT file_id, conversation_uuid, uuid, coalesce(len(attachments), 0) > 0 AS a FROM claude_messages) GROUP BY file_id",
    ),
    "gemini_statistics": (gemini_statistics, f"WITH {_PAIRS} SELECT count(*) AS conversations, CAST(sum(len(lines)) AS BIGINT) AS messages, max(len(lines)) AS longest FROM g"),
    "session_transcripts": (
        session_transcripts,
        f"""WITH m AS (SELECT DISTINCT conversation_uuid AS session, coalesce(msg_index, 4611686018427387904) AS msg_index, uuid, '**' || CASE WHEN lower(coalesce(nullif(sender, ''), role, 'unknown')) IN ('user', 'human') THEN 'User' ELSE 'AI' END || ':** ' || {_SAID} AS line FROM claude_messages WHERE {_SAID} <> '')
        SELECT session, count(*) AS messages, '# Session: ' || session || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY msg_index, line) || chr(10) AS transcript FROM m GROUP BY session""",
    ),
    "html_pages": (html_pages, f"SELECT doc_id, {_STRIP} AS plain FROM documents WHERE text LIKE '<%'"),
    "question_counts": (
        question_counts,
        f"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{markup.labelled(markup.ASKED)}')) AS questions, len(regexp_extract_all(coalesce(text, ''), '{markup.labelled(markup.ANSWERED)}')) AS answers FROM documents""",
    ),
    "cited_links": (cited_links, r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), 'https?://\S+')) AS links, coalesce(array_to_string(regexp_extract_all(coalesce(text, ''), 'https?://\S+')[1:50], ' '), '') AS first_links FROM documents"),
    "parse_documents": (parse_documents, None),
    "decode_documents": (decode_documents, "SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents"),
    "tumbling_events": (tumbling_events, "SELECT epoch_us(date_trunc('hour', ts)) AS window_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "session_events": (
        session_events,
        """SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
    ),
}
