"""Chat exports held as tables: transcripts and statistics by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def said(text: Column, content: Column) -> Column:
    """A message's text; its content pieces, joined by line breaks, where that is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.array_join(F.filter(content, lambda p: p.isNotNull()), "\n"), F.lit(""))


def speaker(sender: Column, role: Column) -> Column:
    raw = F.coalesce(F.nullif(sender, F.lit("")), F.nullif(role, F.lit("")), F.lit("unknown"))
    return F.when(raw == "human", "User").otherwise(F.initcap(raw))


def flat_transcripts(messages: DataFrame, order: str = "msg_index") -> DataFrame:
    """(conv_id, messages, transcript) of conversations by a column that orders their messages (then by uuid, rows without a value
    last); repeated rows count once."""
    rows = messages.select(
        F.col("conversation_uuid").alias("conv_id"), F.coalesce(F.nullif("conversation_name", F.lit("")), F.lit("Untitled")).alias("title"), F.col(order).alias("_o"), "uuid",
        F.concat(F.lit("**"), speaker(F.col("sender"), F.col("role")), F.lit(":** "), said(F.col("text"), F.col("content"))).alias("line"),
    ).distinct()
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_o").isNull().alias("last"), "_o", "uuid", "line"))), lambda x: x["line"])
    grouped = rows.groupBy("conv_id").agg(F.max("title").alias("title"), F.count("*").alias("messages"), lines.alias("lines"))
    return grouped.select("conv_id", "messages", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.array_join("lines", "\n\n"), F.lit("\n")).alias("transcript"))


def numbered(messages: DataFrame, yes: bool = True) -> DataFrame:
    """The messages of conversations in which every message has a position, or those of all others."""
    missing = messages.where("msg_index is null").select("conversation_uuid").distinct()
    return messages.join(missing, messages["conversation_uuid"].eqNullSafe(missing["conversation_uuid"]), "left_anti" if yes else "left_semi")


def pair_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, messages, transcript) of exports that hold prompts and responses; empty ones are passed over."""
    def part(label, text):
        return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), text))
    lines = F.flatten(F.transform(F.coalesce("messages", F.array()), lambda m: F.filter(F.array(part("User", m["prompt"]), part("Gemini", m["response"])), lambda x: x.isNotNull())))
    rows = conversations.select(F.col("id").alias("conv_id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), lines.alias("lines")).distinct()
    body = F.when(F.size("lines") > 0, F.concat(F.array_join("lines", "\n\n"), F.lit("\n"))).otherwise("")
    return rows.select("conv_id", F.size("lines").cast("long").alias("messages"), F.concat(F.lit("# "), "title", F.lit("\n\n"), body).alias("transcript"))


def tree_statistics(nodes: DataFrame) -> DataFrame:
    """(file_id, conversations, nodes, models): per export, with the sorted distinct models it used."""
    rows = nodes.select("file_id", "conv_id", "node_id", "model_slug").distinct()
    return rows.groupBy("file_id").agg(
        F.count_distinct("conv_id").alias("conversations"), F.count("*").alias("nodes"), F.array_join(F.sort_array(F.collect_set("model_slug")), ",").alias("models")
    )


def sessions_of_rows(rows: DataFrame, session: str, order: str, role: str, content: str) -> DataFrame:
    """(session, messages, transcript) of message rows grouped by a session column, as spreadsheets of chats hold them. Each row
    without a session is a session of its own, called ``default``."""
    label = F.when(F.lower(role).isin("user", "human"), "User").otherwise("AI")
    held = rows.where(F.coalesce(F.length(content), F.lit(0)) > 0).select(F.col(session).alias("_s"), F.when(F.col(session).isNull(), F.struct(F.col(order), F.xxhash64(content))).alias("_alone"), F.col(order).alias("_o"), F.concat(F.lit("**"), label, F.lit(":** "), F.col(content)).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_o", "line"))), lambda x: x["line"])
    grouped = held.groupBy("_s", "_alone").agg(F.count("*").alias("messages"), F.array_join(lines, "\n\n").alias("_lines"))
    name = F.coalesce("_s", F.lit("default"))
    return grouped.select(name.alias("session"), "messages", F.concat(F.lit("# Session: "), name, F.lit("\n\n"), "_lines", F.lit("\n")).alias("transcript"))
