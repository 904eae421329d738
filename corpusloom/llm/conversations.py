"""Rebuilding conversations from message rows.

Rows are sessionised by their channel (the conversation id), put in order, given a role from whichever field
names one, and sessions that are broken, empty or without reciprocal replies are dropped.

* A tree export (``parent`` links) is ordered by the path from the current node to the root, a flat one by its
  message positions or, where a conversation has none, by instants.
* Conversations of up to ``limit`` rows are handled as one array each. Larger ones, whatever their size, are never
  gathered: their paths come from pointer doubling and their turn numbers from a range-partitioned sort.

Nulls: rows without conversation or message id are left out, null parts count as absent, a null or empty sender
falls back on ``role`` and a null or empty text on the content pieces. Rows delivered twice count once. A flat
conversation without positions in which some row has no readable time can't be ordered and counts as broken; equal
instants are ordered by message id. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.workspace import materialise
from corpusloom.operators.timestamps import normalise_timestamps

#: Rows of one conversation that are handled as one array.
LIMIT = 5000
USER, ASSISTANT = 1, 2
VISIBLE = r"[^ \t\r\n]"


def role_kind(role: Column) -> Column:
    """1 for a user, 2 for an assistant, 0 for anything else, apart from case and outer blanks."""
    bare = F.lower(F.btrim(role, F.lit(" \t\r\n")))
    return F.when(bare.isin("user", "human"), USER).when(bare == "assistant", ASSISTANT).otherwise(0)


def _reciprocal(turns: Column) -> Column:
    """Whether the first of the turns is a user's and every user turn is directly followed by an assistant's."""
    answered = F.forall(
        F.sequence(F.lit(0), F.size(turns) - 1),
        lambda i: (F.get(turns, i)["kind"] == ASSISTANT) | F.coalesce(F.get(turns, i + 1)["kind"] == ASSISTANT, F.lit(False)),
    )
    return F.when(F.size(turns) > 0, (turns[0]["kind"] == USER) & answered).otherwise(False)


def _unroll(sessions: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (kind, msg_id) in order) to one row per turn of the kept conversations."""
    kept = sessions.where(_reciprocal(F.col("turns")))
    return kept.select("conv_id", F.posexplode(F.transform("turns", lambda x: x["msg_id"])).alias("turn", "msg_id")).select("conv_id", F.col("turn").cast("long").alias("turn"), "msg_id")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path from the current node to the root, reversed, of each conversation in a batch; none if it is broken."""
    for batch in batches:
        convs, currents, lists = batch["conv_id"].to_pylist(), batch["current"].to_pylist(), batch["nodes"]
        flat = lists.flatten()
        node, parent, kind = (flat.field(k).to_pylist() for k in ("node_id", "parent", "kind"))
        at = 0
        out_conv, out_turns = [], []
        for conv, current, n in zip(convs, currents, pc.list_value_length(lists).to_pylist()):
            rows = {node[i]: (parent[i], kind[i]) for i in range(at, at + n)}
            at += n
            path, seen = [], set()
            while current is not None and current in rows and current not in seen:
                seen.add(current)
                path.append(current)
                current = rows[current][0]
            if path and current is None:
                out_conv.append(conv)
                out_turns.append([{"kind": rows[x][1], "msg_id": x} for x in reversed(path) if rows[x][1]])
        kinds = pa.list_(pa.struct([("kind", pa.int32()), ("msg_id", pa.string())]))
        yield pa.RecordBatch.from_arrays([pa.array(out_conv, pa.string()), pa.array(out_turns, kinds)], ["conv_id", "turns"])


def _oversize(rows: DataFrame, limit: int) -> DataFrame | None:
    """Ids of the conversations with more than ``limit`` rows; None if there are none."""
    big = materialise(rows.groupBy("conv_id").count().where(F.col("count") > limit).select("conv_id", "count"), "oversize")
    return None if big.isEmpty() else big


def number_turns(rows: DataFrame) -> DataFrame:
    """Turn numbers and the reply check for conversations too large to gather.

    ``rows``: (conv_id, pos long, msg_id, kind), turns only. A range-partitioned sort spreads one conversation over
    many tasks; each task's share is numbered from the counts of the shares before it.
    """
    spark = rows.sparkSession
    parts = spark.sparkContext.defaultParallelism * 4
    ordered = materialise(
        rows.repartitionByRange(parts, "conv_id", "pos", "msg_id").sortWithinPartitions("conv_id", "pos", "msg_id").withColumn("gid", F.monotonically_increasing_id()), "ordered"
    ).withColumn("part", F.shiftrightunsigned("gid", 33))
    shares = ordered.groupBy("conv_id", "part").agg(F.min("gid").alias("first"), F.count("*").alias("n"))
    before = shares.select("conv_id", "part", "first", F.expr("sum(n) over (partition by conv_id order by part rows between unbounded preceding and current row) - n").alias("before"))
    numbered = materialise(ordered.join(before, ["conv_id", "part"]).select("conv_id", (F.col("gid") - F.col("first") + F.col("before")).alias("turn"), "msg_id", "kind"), "numbered")
    replies = numbered.where(F.col("kind") == ASSISTANT).select("conv_id", (F.col("turn") - 1).alias("turn"))
    unanswered = numbered.where(F.col("kind") == USER).join(replies, ["conv_id", "turn"], "left_anti")
    headless = numbered.where((F.col("turn") == 0) & (F.col("kind") == ASSISTANT))
    dropped = unanswered.select("conv_id").unionByName(headless.select("conv_id")).distinct()
    salted = dropped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return numbered.withColumn("salt", F.pmod("turn", F.lit(64)).cast("int")).join(salted, ["conv_id", "salt"], "left_anti").select("conv_id", "turn", "msg_id")


def paths_by_doubling(nodes: DataFrame, currents: DataFrame, most: int) -> DataFrame:
    """(conv_id, pos, node_id) of the paths from current node to root, for conversations of up to ``most`` nodes.

    After k rounds a path holds its first 2^k nodes and every node knows its 2^k-th ancestor. Conversations whose
    path meets a missing parent or a loop never reach a root and are left out.
    """
    links = materialise(nodes.select("conv_id", "node_id", "parent").distinct(), "links")
    jumps = links.withColumnRenamed("parent", "jump")
    path = currents.select("conv_id", F.col("current").alias("node_id"), F.lit(0).cast("long").alias("rank"))
    reach = 1
    while reach < 2 * most:
        further = path.join(jumps, ["conv_id", "node_id"]).where("jump is not null and rank < {}".format(reach))
        path = materialise(path.unionByName(further.select("conv_id", F.col("jump").alias("node_id"), (F.col("rank") + reach).alias("rank"))), "path")
        twice = jumps.select("conv_id", F.col("node_id").alias("jump"), F.col("jump").alias("next"))
        jumps = materialise(jumps.join(twice, ["conv_id", "jump"], "left").select("conv_id", "node_id", F.col("next").alias("jump")), "jumps")
        reach *= 2
    rooted = path.join(links.where("parent is null"), ["conv_id", "node_id"], "left_semi").select("conv_id").distinct()
    return path.join(rooted, "conv_id", "left_semi").select("conv_id", (-F.col("rank")).alias("pos"), "node_id")


def tree_conversations(nodes: DataFrame, heads: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """Kept conversations of a tree export: (conv_id, turn, msg_id).

    ``nodes``: (conv_id, node_id, parent, role, parts); ``heads``: (conv_id, current_node).
    """
    rows = nodes.where("conv_id is not null and node_id is not null").select(
        "conv_id", "node_id", "parent", F.when(F.exists("parts", lambda p: F.coalesce(p.rlike(VISIBLE), F.lit(False))), role_kind(F.col("role"))).otherwise(0).alias("kind")
    )
    starts = heads.where("conv_id is not null and current_node is not null").select("conv_id", F.col("current_node").alias("current"))
    big = _oversize(rows, limit)
    kept = []
    if big is not None:
        ids = big.select("conv_id")
        most = big.agg(F.max("count")).first()[0]
        large = rows.join(ids, "conv_id", "left_semi")
        path = paths_by_doubling(large, starts.join(ids, "conv_id", "left_semi").groupBy("conv_id").agg(F.max("current").alias("current")), most)
        turns = path.join(large.where("kind > 0").select("conv_id", "node_id", "kind").distinct(), ["conv_id", "node_id"])
        kept.append(number_turns(turns.select("conv_id", "pos", F.col("node_id").alias("msg_id"), "kind")))
        rows, starts = rows.join(ids, "conv_id", "left_anti"), starts.join(ids, "conv_id", "left_anti")
    both = rows.withColumn("current", F.lit(None).cast("string")).unionByName(starts, allowMissingColumns=True)
    grouped = both.groupBy("conv_id").agg(
        F.max("current").alias("current"), F.collect_list(F.when(F.col("node_id").isNotNull(), F.struct("node_id", "parent", "kind"))).alias("nodes")
    )
    walked = grouped.where("current is not null").mapInArrow(_walk, "conv_id string, turns array<struct<kind:int,msg_id:string>>")
    result = _unroll(walked)
    for part in kept:
        result = result.unionByName(part)
    return result


def flat_conversations(messages: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """Kept conversations of a flat export: (conv_id, turn, msg_id).

    ``messages``: conversation_uuid, uuid, sender, role, text, content, msg_index, created_at, client_tz, locale.
    """
    role = F.coalesce(F.nullif("sender", F.lit("")), F.nullif("role", F.lit("")))
    joined = F.array_join(F.filter("content", lambda p: p.isNotNull()), "\n")
    text = F.coalesce(F.nullif("text", F.lit("")), joined)
    rows = messages.where("conversation_uuid is not null and uuid is not null").select(
        F.col("conversation_uuid").alias("conv_id"), F.col("uuid").alias("msg_id"), F.col("msg_index").alias("idx"),
        F.when(F.coalesce(text.rlike(VISIBLE), F.lit(False)), role_kind(role)).otherwise(0).alias("kind"),
        role.isNull().alias("nameless"), F.when(F.col("msg_index").isNull(), F.col("created_at")).alias("raw"), "client_tz", "locale",
    )
    timed = normalise_timestamps(rows.where("idx is null and raw is not null"), "raw", "client_tz", "locale")
    plain = rows.where("idx is not null or raw is null").withColumn("utc_us", F.lit(None).cast("long"))
    rows = plain.unionByName(timed).select("conv_id", "msg_id", "idx", "kind", "nameless", "utc_us")
    big = _oversize(rows, limit)
    kept = []
    if big is not None:
        ids = big.select("conv_id")
        large = materialise(rows.join(ids, "conv_id", "left_semi").distinct(), "large")
        shape = large.groupBy("conv_id").agg(
            F.count("*").alias("n"), F.count("idx").alias("n_idx"), F.count_distinct("idx").alias("n_own"), F.min("idx").alias("least"), F.max("idx").alias("most"),
            F.bool_or("nameless").alias("nameless"), F.count("utc_us").alias("n_utc"),
        )
        sound = shape.where("not nameless and ((n_idx = 0 and n_utc = n) or (n_own = n and n_idx = n and least = 0 and most = n - 1))").select("conv_id")
        turns = large.join(sound, "conv_id", "left_semi").where("kind > 0")
        kept.append(number_turns(turns.select("conv_id", F.coalesce("idx", "utc_us").alias("pos"), "msg_id", "kind")))
        rows = rows.join(ids, "conv_id", "left_anti")
    grouped = rows.groupBy("conv_id").agg(
        F.array_sort(F.array_distinct(F.collect_list(F.struct(F.coalesce("idx", "utc_us").alias("pos"), "msg_id", "kind", F.col("idx").isNotNull().alias("indexed"))))).alias("rows"),
        F.bool_or("nameless").alias("nameless"),
    )
    n = F.size("rows")
    indexed = F.exists("rows", lambda r: r["indexed"])
    complete = F.transform("rows", lambda r: r["pos"]) == F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))
    placed = F.forall("rows", lambda r: r["pos"].isNotNull())
    sound = grouped.where(~F.col("nameless") & placed & (~indexed | (F.forall("rows", lambda r: r["indexed"]) & complete)))
    turns = F.transform(F.filter("rows", lambda r: r["kind"] > 0), lambda r: F.struct(r["kind"].alias("kind"), r["msg_id"].alias("msg_id")))
    result = _unroll(sound.select("conv_id", turns.alias("turns")))
    for part in kept:
        result = result.unionByName(part)
    return result


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of the kept conversations: (platform, conv_id, turn, msg_id)."""
    def read(t):
        return spark.read.parquet(f"{sf_dir}/{t}.parquet")
    tree = tree_conversations(read("chatgpt_nodes"), read("chatgpt_conversations")).withColumn("platform", F.lit("chatgpt"))
    flat = flat_conversations(read("claude_messages")).withColumn("platform", F.lit("claude"))
    return tree.unionByName(flat).select("platform", "conv_id", "turn", "msg_id")
