"""The entity graph: extraction, upserts, neighbourhoods, orphans, components and communities."""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.workspace import materialise

#: Words that a capitalised run may not begin with.
STOPWORDS = (
    "The This That These Those Then There Their They When What Where Which While With Will Your Yours About Above After Again Also Been Before Could Does During Every From Have Here "
    "However Into Many More Most Much Must Only Over Said Same Should Some Such Than Through Under Very Well Were Would January February March April June July August September October "
    "November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday"
).split()
#: The runs that count as names (word boundaries are those of any script), and the sentence of a summary.
CAPITALISED = r"(?U)\b[A-Z][a-zA-Z]{3,}(?:\s+[A-Z][a-zA-Z]+){0,2}\b"
#: Parts of a unit of weight that modularity reckons in.
UNIT = 1_000_000


def entity_id(name: Column, kind: Column) -> Column:
    """``ent_`` and 16 hex digits of the sha1 of lower-case type and trimmed lower-case name."""
    return F.concat(F.lit("ent_"), F.substring(F.sha1(F.concat(F.lower(kind), F.lit("::"), F.lower(F.trim(name)))), 1, 16))


def spotted_entities(text: Column, most: int = 5) -> Column:
    """The first distinct capitalised runs of a text, apart from case, without those that begin with a stopword. Blanks of any kind
    count as spaces."""
    blanks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{85}\p{Z}]", " ")
    runs = F.regexp_extract_all(blanks, F.lit(CAPITALISED), F.lit(0))
    def add(kept: Column, run: Column) -> Column:
        known = F.exists(kept, lambda k: F.lower(k) == F.lower(run)) | F.regexp_extract(run, r"^(\S+)", 1).isin(STOPWORDS)
        return F.when((F.size(kept) < most) & ~known, F.concat(kept, F.array(run))).otherwise(kept)

    return F.aggregate(runs, F.array().cast("array<string>"), add)


def chained(entities: Column) -> Column:
    """Edges (source, target, weight 0.5) between consecutive entities."""
    def edges(found: Column) -> Column:
        pair = lambda i: F.struct(F.get(found, i - 1).alias("source"), F.get(found, i).alias("target"), F.lit(0.5).alias("weight"))
        return F.when(F.size(found) > 1, F.transform(F.sequence(F.lit(1), F.size(found) - 1), pair))

    once = F.get(F.transform(F.array(entities), edges), 0)  # bound to a variable, so that it is evaluated once
    return F.coalesce(once, F.array().cast("array<struct<source:string,target:string,weight:double>>"))


def upsert_entities(extractions: DataFrame) -> DataFrame:
    """(id, name, entity_type, description) of the entities in extractions, the last write winning. Null types count as
    Concept; blank and null names are left out."""
    rows = extractions.select("extracted_at", "chunk_id", F.posexplode("entities").alias("pos", "e"))
    rows = rows.select("extracted_at", "chunk_id", "pos", F.col("e.name").alias("name"), F.coalesce("e.entity_type", F.lit("Concept")).alias("entity_type"), F.coalesce("e.description", F.lit("")).alias("description"))
    rows = rows.where("trim(name) <> ''").withColumn("id", entity_id(F.col("name"), F.col("entity_type")))
    last = F.max(F.struct("extracted_at", "chunk_id", "pos", "name", "entity_type", "description")).alias("_last")
    return rows.groupBy("id").agg(last).select("id", "_last.name", "_last.entity_type", "_last.description")


def upsert_relations(extractions: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, dst, weight) between entities by their lower-case trimmed names, the last write winning.

    Relations to themselves and to names that no entity bears are dropped; a name that several types share stands for the
    least id. Null and zero weights count as 1.
    """
    ids = entities.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("id").alias("id"))
    rows = extractions.select("extracted_at", "chunk_id", F.posexplode("relations").alias("pos", "r")).select(
        "extracted_at", "chunk_id", "pos", F.lower(F.trim("r.source")).alias("s"), F.lower(F.trim("r.target")).alias("t"), F.coalesce(F.nullif("r.weight", F.lit(0.0)), F.lit(1.0)).alias("weight")
    )
    joined = rows.join(ids.select(F.col("key").alias("s"), F.col("id").alias("src")), "s").join(ids.select(F.col("key").alias("t"), F.col("id").alias("dst")), "t").where("src <> dst")
    return joined.groupBy("src", "dst").agg(F.max_by("weight", F.struct("extracted_at", "chunk_id", "pos", "weight")).alias("weight"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, id, hop): everything within 1 to 5 undirected hops of each seed (id), at its least distance, the seed excluded."""
    hops = max(1, min(5, hops))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop"))
    frontier = reached
    for h in range(1, hops + 1):
        step = frontier.join(both, frontier["id"] == both["src"]).select("seed", F.col("dst").alias("id")).distinct()
        frontier = materialise(step.join(reached.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(h)), "frontier")
        reached = reached.unionByName(frontier)
    return reached.where("hop > 0")


def orphans(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities that no chunk (id, chunk_id) is linked to, summaries excepted."""
    return entities.where("entity_type <> 'Summary'").join(links.select("id"), "id", "left_anti")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): connected components, named by their least id.

    Every node keeps the least id heard of; in each round it hears its neighbours' and then that of the id it keeps, so
    distances to the name about double. Each round is written out, so lost executors cost one round.
    """
    both = materialise(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "edges")
    labels = materialise(nodes.select("id", F.col("id").alias("component")).distinct(), "labels")
    while True:
        heard = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("heard"))
        near = labels.join(heard, labels["id"] == heard["src"], "left").select("id", F.col("component").alias("before"), F.least("component", F.coalesce("heard", "component")).alias("component"))
        near = materialise(near, "near")
        leap = near.select(F.col("id").alias("component"), F.col("component").alias("leap"))
        labels = materialise(near.join(leap, "component", "left").select("id", "before", F.least("component", F.coalesce("leap", "component")).alias("component")), "labels")
        if labels.where("before <> component").isEmpty():
            return labels.select("id", "component")


def greedy_modularity(edges: list[tuple[str, str, float]], total: float) -> list[list[str]]:
    """Communities of one component by greedy merging (Clauset, Newman and Moore 2004), one merger after the other: what
    tests hold ``membership`` against. ``total`` is the weight of the whole graph.

    Ties go to the least pair of names.
    """
    weight: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in edges:
        weight[a][b] = weight[b][a] = w
    share = {n: sum(x.values()) / (2 * total) for n, x in weight.items()}
    gain = {a: {b: w / total - 2 * share[a] * share[b] for b, w in x.items()} for a, x in weight.items()}
    members = {n: [n] for n in weight}
    queue = [(-g, a, b) for a, x in gain.items() for b, g in x.items() if a < b]
    heapq.heapify(queue)
    while queue:
        g, a, b = heapq.heappop(queue)
        if a not in gain or gain[a].get(b) != -g:
            continue
        if -g <= 0:
            break
        for c in {*gain[a], *gain[b]} - {a, b}:
            ga, gb = gain[a].get(c), gain[b].get(c)
            new = ga + gb if ga is not None and gb is not None else ga - 2 * share[b] * share[c] if ga is not None else gb - 2 * share[a] * share[c]
            gain[a][c] = gain[c][a] = new
            gain[c].pop(b, None)
            heapq.heappush(queue, (-new, min(a, c), max(a, c)))
        gain[a].pop(b, None)
        del gain[b]
        share[a] += share.pop(b)
        members[a] = sorted(members[a] + members.pop(b))
    return sorted(members.values(), key=lambda m: (-len(m), m))


def _picks(pairs: DataFrame, shares: DataFrame, twice: float) -> DataFrame:
    """(id, other, loss, w, k, other_k): the partner whose merger with each node gains most, where any gains."""
    gain = F.lit(twice) * F.col("w") - F.col("ka").cast("double") * F.col("kb")
    met = pairs.join(shares.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(shares.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b").withColumn("loss", -gain).where("loss < 0")
    def side(own: str, other: str) -> Column:
        pick = F.struct("loss", "a", "b", "w", F.col(f"k{own}").alias("k"), F.col(other).alias("other"), F.col(f"k{other}").alias("other_k"))
        return F.struct(F.col(own).alias("id"), pick.alias("p"))

    sides = F.array(side("a", "b"), side("b", "a"))
    best = met.select(F.explode(sides).alias("side")).groupBy("side.id").agg(F.min("side.p").alias("p"))
    return best.select("id", "p.other", "p.loss", "p.w", "p.k", "p.other_k")


def _moves(picks: DataFrame, twice: float, turn: int) -> DataFrame:
    """(id, head): mergers that together raise modularity, among them the one that gains most.

    Of two nodes that pick each other the heavier is a head and the other moves; else a coin decides. A node moves if its
    pick is a head. Moves to one head are taken in order of gain, each counted as if all before it had been made.
    """
    heavier = (F.col("k") > F.col("other_k")) | ((F.col("k") == F.col("other_k")) & (F.col("id") < F.col("other")))
    coin = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
    after = picks.select(F.col("id").alias("other"), F.col("other").alias("next"))
    roles = picks.join(after, "other").withColumn("head", F.when(F.col("next") == F.col("id"), heavier).otherwise(coin))
    asking = roles.where("not head").join(roles.where("head").select(F.col("id").alias("other")), "other")
    before = F.coalesce(F.sum("k").over(Window.partitionBy("other").orderBy("loss", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gain = F.lit(twice) * F.col("w") - F.col("k").cast("double") * (F.col("other_k") + before)
    return asking.withColumn("gain", gain).where("gain > 0").select("id", F.col("other").alias("head"))


def membership(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community) by greedy modularity over the whole graph, a community being named by one of its nodes.

    As in Clauset, Newman and Moore (2004) neighbouring communities merge as long as that raises modularity; here many
    mergers are made in one round, chosen so that their gains add up. Each round is written out. Ties go to the least pair
    of names; weights are whole multiples of 1 / ``UNIT``, so that sums are exact in any order.
    """
    weights = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.01)).alias("w")).where("a <> b")
    pairs = materialise(weights.groupBy("a", "b").agg(F.round(F.max("w") * UNIT).cast("long").alias("w")), "pairs")
    twice = 2.0 * (pairs.agg(F.sum("w")).first()[0] or 0)
    ends = pairs.select(F.col("a").alias("id"), "w").unionByName(pairs.select(F.col("b").alias("id"), "w"))
    shares = materialise(ends.groupBy("id").agg(F.sum("w").alias("k")), "shares")
    labels = nodes.select("id").unionByName(shares.select("id")).distinct().withColumn("community", F.col("id"))
    for turn in count():
        picks = materialise(_picks(pairs, shares, twice), "picks")
        if picks.isEmpty():
            return labels
        moves = materialise(_moves(picks, twice, turn), "moves")
        at = lambda name: moves.select(F.col("id").alias(name), F.col("head").alias(f"{name}_head"))
        now = lambda name: F.coalesce(f"{name}_head", name)
        moved = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.least(now("a"), now("b")).alias("a"), F.greatest(now("a"), now("b")).alias("b"), "w")
        pairs = materialise(moved.where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w")), "pairs")
        shares = materialise(shares.join(at("id"), "id", "left").groupBy(now("id").alias("id")).agg(F.sum("k").alias("k")), "shares")
        labels = materialise(labels.join(at("community"), "community", "left").select("id", now("community").alias("community")), "labels")


def community_rows(nodes: DataFrame, edges: DataFrame, *, least: int = 2) -> DataFrame:
    """(community_id, id, size): the members of the communities of at least so many. The name is a hash over the sorted
    members, which are streamed, so that a community of any size fits."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, size = None, None, 0
        for batch in batches:
            done = []
            for community, member in zip(batch["community"].to_pylist(), batch["id"].to_pylist()):
                if community != at:
                    if at is not None:
                        done.append((at, f"community_{digest.hexdigest()[:16]}", size))
                    at, digest, size = community, hashlib.sha1(member.encode()), 1
                else:
                    digest.update(f"|{member}".encode())
                    size += 1
            yield _named(done)
        if at is not None:
            yield _named([(at, f"community_{digest.hexdigest()[:16]}", size)])

    members = materialise(membership(nodes, edges), "members")
    names = members.repartition("community").sortWithinPartitions("community", "id").mapInArrow(name, "community string, community_id string, size long")
    return members.join(names.where(F.col("size") >= least), "community").select("community_id", "id", "size")


def _named(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    kinds = {"community": pa.string(), "community_id": pa.string(), "size": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def largest(rows: DataFrame, most: int | None = 20) -> DataFrame:
    """The rows of the ``most`` largest communities."""
    if most is None:
        return rows
    top = rows.select("community_id", "size").distinct().orderBy(F.desc("size"), "community_id").limit(most)
    return rows.join(F.broadcast(top.select("community_id")), "community_id", "left_semi")


def communities(nodes: DataFrame, edges: DataFrame, *, least: int = 2, most: int | None = 20) -> DataFrame:
    """(community_id, members, size), largest first, for communities that fit a row; else see ``community_rows``."""
    rows = largest(materialise(community_rows(nodes, edges, least=least), "communities"), most)
    return rows.groupBy("community_id", "size").agg(F.sort_array(F.collect_list("id")).alias("members")).select("community_id", "members", "size").orderBy(F.desc("size"), "community_id")


def summaries(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(community_id, summary) of communities (community_id, id, size) by a fixed sentence with the first eight names."""
    pos = F.row_number().over(Window.partitionBy("community_id").orderBy("id"))
    named = found.join(entities.select("id", "name"), "id").withColumn("pos", pos).where("pos <= 8")
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return named.groupBy("community_id", "size").agg(names.alias("names")).select(
        "community_id", F.format_string("[auto-generated template] Community of %d entities including %s.", "size", F.array_join("names", ", ")).alias("summary")
    )
