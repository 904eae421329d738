"""Files to text: every format by column expressions, but for containers, whose bytes a helper unpacks.

Chat exports are read with ``from_json`` and variants and rendered like the exports held as tables; texts and pages are
decoded; members of archives come out as rows of their own for another pass. Broken input never raises: it gives an empty
text and an ``error`` in the metadata. Null content counts as empty. PDF, images and audio give metadata only: their
text needs extraction, recognition or transcription that isn't part of this engine.
"""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.files import media_type, parser_of
from corpusloom.sources import markup

MOST_DEPTH, MOST_MEMBERS, MOST_UNPACKED = 3, 1000, 100 * 1024 * 1024
BETWEEN = "\n---\n\n"
CHATS = ("chatgpt", "claude", "gemini", "ai_generic")
MEMBERS = "array<struct<name:string,content:binary>>"
NODE = "struct<parent:string,message:struct<author:struct<role:string>,content:struct<parts:array<variant>>>>"
TREES = f"array<struct<title:string,current_node:string,mapping:map<string,{NODE}>>>"
MESSAGE = "struct<sender:string,role:string,text:string,content:variant,prompt:string,query:string,response:string,answer:string>"
LISTS = f"array<struct<name:string,title:string,chat_messages:array<{MESSAGE}>,messages:array<{MESSAGE}>,turns:array<{MESSAGE}>,conversation:array<{MESSAGE}>>>"
TURNS = "array<struct<who:string,said:string>>"


def _filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def _string(value: Column) -> Column:
    """A variant's text, null for one of another type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _text_of(content: Column) -> Column:
    """A message's content, given as a text, a list of texts, or a list of records with texts."""
    piece = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), _string(x))
    listed = F.try_variant_get(content, "$", "array<variant>")
    return F.when(listed.isNotNull(), F.array_join(F.transform(listed, piece), "\n")).otherwise(_string(content))


def tree_turns(current: Column, mapping: Column) -> Column:
    """Turns on the path from the root to the current node; of all nodes in file order where there is no such node."""
    begin = F.struct(current.alias("at"), F.array().cast("array<string>").alias("path"))

    def up(state: Column, _: Column) -> Column:
        on = F.coalesce(F.map_contains_key(mapping, state["at"]), F.lit(False)) & ~F.array_contains(state["path"], state["at"])
        return F.when(on, F.struct(mapping[state["at"]]["parent"].alias("at"), F.concat(F.array(state["at"]), state["path"]).alias("path"))).otherwise(state)

    path = F.aggregate(F.map_keys(mapping), begin, up, lambda s: s["path"])
    nodes = F.when(F.coalesce(F.map_contains_key(mapping, current), F.lit(False)), path).otherwise(F.map_keys(mapping))

    def turn(key: Column) -> Column:
        message = mapping[key]["message"]
        role = F.coalesce(message["author"]["role"], F.lit("unknown"))
        parts = F.filter(F.transform(message["content"]["parts"], _string), lambda p: p.isNotNull())
        who = F.when(role.isin("user", "assistant", "system"), F.initcap(role)).otherwise(role)
        return F.struct(who.alias("who"), F.btrim(F.coalesce(F.array_join(parts, "\n"), F.lit("")), F.lit(" \t\r\n")).alias("said"))

    return F.filter(F.transform(nodes, turn), lambda t: t["said"] != "").cast(TURNS)


def list_turns(messages: Column, parser: Column) -> Column:
    """Turns of a list of messages: a prompt and its response, or what a sender said."""
    pairs = F.when(parser == "gemini", "Gemini").otherwise("AI")

    def turns(m: Column) -> Column:
        sender = F.lower(F.coalesce(_filled(m["sender"], m["role"]), F.lit("unknown")))
        who = F.when(sender.isin("user", "human"), "User").when(parser == "claude", F.initcap(sender)).otherwise(pairs)
        asked, answered = _filled(m["prompt"], m["query"]), _filled(m["response"], m["answer"])
        said = F.when(asked.isNull() & answered.isNull(), _filled(m["text"], _text_of(m["content"])))
        three = F.array(F.struct(F.lit("User").alias("who"), asked.alias("said")), F.struct(pairs.alias("who"), answered.alias("said")), F.struct(who.alias("who"), said.alias("said")))
        return F.filter(three, lambda t: t["said"].isNotNull())

    return F.flatten(F.transform(messages, turns)).cast(TURNS)


def conversations(text: Column, parser: Column) -> Column:
    """array<struct<title, turns>> of a chat export's JSON; null where it can't be read."""
    trees = F.transform(F.from_json(text, TREES), lambda c: F.struct(F.coalesce(c["title"], F.lit("Untitled")).alias("title"), tree_turns(c["current_node"], c["mapping"]).alias("turns")))
    whole = F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    one = lambda c: F.struct(F.coalesce(_filled(c["name"], c["title"]), F.lit("Untitled")).alias("title"), list_turns(F.coalesce(c["chat_messages"], c["messages"], c["turns"], c["conversation"]), parser).alias("turns"))
    lists = F.transform(F.from_json(whole, LISTS), one)
    return F.when(parser == "chatgpt", trees).otherwise(lists)


def rendered(title: Column, turns: Column) -> Column:
    lines = F.transform(F.coalesce(turns, F.array().cast(TURNS)), lambda t: F.concat(F.lit("**"), t["who"], F.lit(":** "), t["said"]))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n\n"), F.lit("\n"))).otherwise(""))


def _archive_members(path: str, data: bytes) -> list[tuple[str, bytes]]:
    """Members within the limits: deeper ones are passed over, and it ends at the first beyond the number or the size."""
    if zipfile.is_zipfile(io.BytesIO(data)):
        z = zipfile.ZipFile(io.BytesIO(data))
        found = ((i.filename, i.file_size, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir())
    else:
        t = tarfile.open(fileobj=io.BytesIO(data))
        found = ((m.name, m.size, lambda m=m: t.extractfile(m).read()) for m in t.getmembers() if m.isfile())
    kept, total = [], 0
    for name, size, read in found:
        if len(PurePosixPath(name).parts) > MOST_DEPTH:
            continue
        if len(kept) >= MOST_MEMBERS or total + size > MOST_UNPACKED:
            break
        kept.append((name, read()))
        total += size
    return kept


def _office_text(data: bytes) -> str:
    """Paragraphs of a document's parts in order, cells of a row side by side."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = sorted((n for n in z.namelist() if n.endswith(".xml") and n.startswith(("word/document", "ppt/slides/slide", "xl/sharedStrings"))), key=lambda n: (len(n), n))
        if not parts:
            raise ValueError("no text parts")
        for part in parts:
            for node in ElementTree.fromstring(z.read(part)).iter():
                if node.tag.rpartition("}")[2] in ("p", "si"):
                    out.append("".join(t.text or "" for t in node.iter() if t.tag.rpartition("}")[2] == "t"))
    return "\n\n".join(p for p in out if p.strip())


UNPACKED = T.StructType().add("text", T.StringType()).add("metadata", T.StringType())
UNPACKED = UNPACKED.add("members", T.ArrayType(T.StructType().add("name", T.StringType()).add("content", T.BinaryType())))


@F.pandas_udf(UNPACKED)
def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Text or members of a container (path, office, content); null content (no container) gives nulls."""
    for frame in frames:
        out = []
        for path, office, data in zip(frame["path"], frame["office"], frame["content"]):
            if data is None:
                out.append((None, None, None))
                continue
            try:
                if office:
                    text = _office_text(data)
                    out.append((text, json.dumps({"char_count": len(text)}), []))
                else:
                    members = _archive_members(path, data)
                    out.append(("\n".join(n for n, _ in members), json.dumps({"file_count": len(members), "total_size": sum(len(d) for _, d in members)}), [{"name": n, "content": d} for n, d in members]))
            except Exception as e:  # one broken file must not end the job
                out.append(("", json.dumps({"error": f"corrupt: {type(e).__name__}"}), []))
        yield pd.DataFrame(out, columns=["text", "metadata", "members"], dtype=object)


def parse_files(files: DataFrame) -> DataFrame:
    """(path, parser, text, metadata, members) of a table (path, content) of whole files, as Spark's binary source reads them."""
    path, content = F.col("path"), F.coalesce("content", F.lit("").cast("binary"))
    routed = files.select("path", parser_of(path, media_type(path, F.substring("content", 1, 16))).alias("parser"), content.alias("content"))
    parser, chat, zipped = F.col("parser"), F.col("parser").isin(*CHATS), F.lower("path").rlike(r"\.(zip|tar|tgz|gz|bz2|xz)$")
    boxed = parser.isin("office", "archive") | chat & zipped
    silent = parser.isin("pdf", "image", "audio", "none")
    held = routed.select("path", "parser", F.octet_length("content").alias("size"), boxed.alias("boxed"), silent.alias("silent"), F.when(~boxed & ~silent, markup.decoded(F.col("content"))).alias("plain"),
                         _unpacked(F.struct("path", (parser == "office").alias("office"), F.when(boxed, F.col("content")).alias("content"))).alias("box"))
    as_json = chat & F.lower("path").endswith(".json") & F.col("plain").isNotNull()
    told = held.withColumn("talks", F.when(as_json, conversations(F.col("plain"), parser)))
    page = F.when(F.lower("path").rlike(r"\.html?$") & (parser == "gemini"), markup.strip_html(F.col("plain"))).otherwise(F.col("plain"))
    spoken = F.array_join(F.transform("talks", lambda c: rendered(c["title"], c["turns"])), BETWEEN)
    text = F.when(F.col("boxed"), F.col("box.text")).when(as_json, F.coalesce(spoken, F.lit(""))).otherwise(F.coalesce(page, F.lit("")))
    counts = F.aggregate("talks", F.lit(0), lambda n, c: n + F.coalesce(F.size(c["turns"]), F.lit(0)))
    titles = F.transform("talks", lambda c: F.struct(c["title"].alias("title"), F.coalesce(F.size(c["turns"]), F.lit(0)).alias("message_count")))
    of_chat = F.when(F.col("talks").isNull(), F.to_json(F.struct(parser.alias("platform"), F.lit("json_decode").alias("error")))).otherwise(
        F.to_json(F.struct(parser.alias("platform"), F.size("talks").alias("conversation_count"), counts.alias("total_messages"), titles.alias("conversations")))
    )
    lines = F.length("plain") - F.length(F.translate("plain", "\n", "")) + 1
    of_page = F.to_json(F.struct(F.length("plain").alias("char_count"), lines.alias("line_count")))
    of_silent = F.to_json(F.struct(F.regexp_extract(F.lower("path"), r"\.([^./]*)$", 1).alias("format"), F.col("size").alias("file_size"), (parser == "audio").alias("needs_transcription"), (parser.isin("image", "pdf")).alias("needs_ocr")))
    metadata = F.when(F.col("boxed"), F.col("box.metadata")).when(as_json, of_chat).when(F.col("silent"), of_silent).otherwise(of_page)
    return told.select("path", "parser", text.alias("text"), metadata.alias("metadata"), F.coalesce("box.members", F.array().cast(MEMBERS)).alias("members"))


def expand_members(parsed: DataFrame) -> DataFrame:
    """(path, content) of the members of archives, each below its archive's path, ready for another pass."""
    return parsed.select("path", F.explode("members").alias("m")).select(F.concat("path", F.lit("!/"), "m.name").alias("path"), F.col("m.content").alias("content"))


def read_sessions(spark, path: str) -> DataFrame:
    """(session, at, who, said) of spreadsheets of chat rows, whatever they call their columns; rows keep their order by ``at``."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    def named(*names):
        found = [F.col(f"`{c}`") for n in names for c in rows.columns if c.lower() == n]
        return F.coalesce(*found, F.lit(None).cast("string")) if found else F.lit(None).cast("string")
    return rows.select(named("sessionid", "session_id", "conversationid", "conversation_id").alias("session"), F.monotonically_increasing_id().alias("at"), named("role", "sender").alias("who"), named("content", "message").alias("said"))


def scan_directory(spark, root: str) -> DataFrame:
    """(path, size, mtime, content) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "content")
