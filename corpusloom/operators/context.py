"""What surrounds a hit or a query: the files that hold a chunk, the entities a text names, and their neighbours in the graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.workspace import materialise
from corpusloom.operators.search import folded_tokens

#: Edges that a task holds at a time.
HELD = 4_000_000
#: The filter of names has so many bits, as a power of 2: 16 MB are broadcast. More names only pass more runs.
FILTER_BITS, MIXER = 27, np.uint64(0x9E3779B97F4A7C15)


def with_files(hits: DataFrame, subscribed: DataFrame, files: DataFrame) -> DataFrame:
    """Hits (chunk_id, ...) with file_id, sequence and path of every file that holds the chunk; hits that none holds stay, with nulls."""
    held = hits.join(subscribed.select("chunk_id", "file_id", "sequence"), "chunk_id", "left")
    return held.join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").select(*hits.columns, "file_id", "sequence", "path")


def _bit(words: list[str]) -> int:
    """The filter's bit of a run of words."""
    run = 0
    for w in words:
        run = run * int(MIXER) + xxhash.xxh3_64_intdigest(w) & (1 << 64) - 1
    return (run * int(MIXER) & (1 << 64) - 1) >> 64 - FILTER_BITS


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_bit(w) for w in batch["_w"].to_pylist()], pa.int64())], ["bit"])


def named_in(texts: DataFrame, key: str, text: str, entities: DataFrame) -> DataFrame:
    """(key, id) of the entities (id, name) whose names occur, as whole words apart from case and accents, in each text.

    Names join by their words with the runs of as many words of the texts, so no text is held against every name; only
    lengths that names have are made, and only runs that pass a filter of the names leave their task. Null and empty names
    and texts match nothing.
    """
    names = materialise(entities.select("id", folded_tokens(F.col("name")).alias("_w")).where("size(_w) > 0").select("id", "_w", F.size("_w").alias("_n"), F.array_join("_w", " ").alias("_run")), "names")
    lengths = {r[0] for r in names.select("_n").distinct().collect()}
    filled = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    bit = names.select("_w").mapInArrow(_bits_of, "bit long").distinct().toArrow()["bit"].to_numpy()
    np.bitwise_or.at(filled, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
    shared = texts.sparkSession.sparkContext.broadcast(filled)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            words, size = batch["_w"].flatten(), batch["_w"].value_lengths().to_numpy()
            coded = words.dictionary_encode()
            hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
            row = np.repeat(np.arange(len(size)), size)
            left = np.cumsum(size)[row] - np.arange(len(row))
            found, run = set(), np.zeros(len(row), np.uint64)
            for n in range(1, max(lengths, default=0) + 1):
                at = np.flatnonzero(left >= n)  # the starts of runs of n words within a text
                if not len(at):
                    break
                run[at] = run[at] * MIXER + hashed[at + (n - 1)]
                if n in lengths:
                    slot = (run[at] * MIXER >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    for i in at[filled[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0].tolist():
                        found.add((int(row[i]), " ".join(words.slice(i, n).to_pylist())))
            rows, said = zip(*sorted(found)) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(rows, pa.int64())), pa.array(said, pa.string())], [key, "_run"])

    said = texts.select(key, folded_tokens(F.col(text)).alias("_w")).where("size(_w) > 0")
    found = said.mapInArrow(runs, f"{key} {texts.schema[key].dataType.simpleString()}, _run string")
    return found.join(names.select("id", "_run"), "_run").select(key, "id").distinct()


def around(named: DataFrame, key: str, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(key, id, hop): what lies within ``hops`` undirected hops of the entities a query names, at its least distance, these excluded.

    Distances are found once per entity pair of a round; each round is written out.
    """
    both = materialise(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    reached, frontier = named.select(key, "id", F.lit(0).alias("hop")), named.select(key, "id")
    for hop in range(1, hops + 1):
        step = frontier.join(both, frontier["id"] == both["src"]).select(key, F.col("dst").alias("id")).distinct()
        frontier = materialise(step.join(reached.select(key, "id"), [key, "id"], "left_anti"), "frontier")
        reached = reached.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return reached.where("hop > 0")


def _spread(keep: bool):
    """Rows (slot, text, key, front, seen) of one slot, edges first, to (key, seen, fresh, entities): what the front's edges lead to that
    isn't seen yet. An edge row holds its source in ``front`` and its targets in ``seen``."""

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64), column.flatten().to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, graph = [], None
        for batch in batches:
            edges = len(batch) - int(np.count_nonzero(batch["text"].to_numpy(zero_copy_only=False)))
            if edges:
                held.append((batch["front"].slice(0, edges).flatten().to_numpy(), *lists(batch["seen"].slice(0, edges))))
            if edges == len(batch):
                continue
            if graph is None:
                source = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.int64)
                length = np.concatenate([np.diff(x[1]) for x in held]) if held else source
                ids, place = np.unique(np.concatenate([x[2] for x in held]) if held else source, return_inverse=True)
                order, ends = np.argsort(source), np.cumsum(length)
                graph, held = (source[order], (ends - length)[order], ends[order]), []
                met = np.zeros(len(ids), bool)
            rows = batch.slice(edges)
            (at, front), (seen_at, seen) = lists(rows["front"]), lists(rows["seen"])
            source, begin, end = graph
            x, y = np.searchsorted(source, front), np.searchsorted(ids, seen)
            known = np.concatenate([source, [-1]])[x] == front
            among = np.concatenate([ids, [-1]])[y] == seen
            fresh, count = [], []
            for i in range(len(rows)):
                for j in x[at[i] : at[i + 1]][known[at[i] : at[i + 1]]]:
                    met[place[begin[j] : end[j]]] = True
                met[y[seen_at[i] : seen_at[i + 1]][among[seen_at[i] : seen_at[i + 1]]]] = False
                count.append(int(np.count_nonzero(met)))
                fresh.append(ids[met] if keep else ids[:0])
                met[:] = False
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in fresh])]).astype(np.int32)
            fresh = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(fresh)))
            yield pa.RecordBatch.from_arrays([rows["key"], rows["carried"], fresh, pa.array(count, pa.int64())], ["key", "seen", "fresh", "entities"])

    return scan


def counts_around(named: DataFrame, key: str, edges: DataFrame, hops: int = 2, held: int = HELD) -> DataFrame:
    """(key, hop, entities): how many rows ``around`` has for each key and distance, without listing them.

    A row per query carries what it has reached as numbers and meets the graph in slices by target, of ``held`` edges each, so nothing
    but counts is written for the last hop and no task holds more of the graph than a slice.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    numbers = materialise(both.select(F.col("src").alias("id")).distinct().withColumn("no", F.monotonically_increasing_id()), "numbers")
    both = both.join(numbers.select(F.col("id").alias("src"), F.col("no").alias("a")), "src").join(numbers.select(F.col("id").alias("dst"), F.col("no").alias("b")), "dst")
    both = materialise(both.select("a", "b"), "both")
    slices, salts = max(1, -(-both.count() // held)), both.sparkSession.sparkContext.defaultParallelism
    of = F.pmod(F.xxhash64("b"), F.lit(slices)).alias("slice")
    graph = both.groupBy("a", of).agg(F.collect_list("b").alias("seen")).select("slice", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.array("a").alias("front"), "seen")
    kind = named.schema[key].dataType.simpleString()
    slot = (F.col("slice") * salts + F.col("salt")).cast("int").alias("slot")
    none = F.lit(None).cast("array<bigint>")
    graph = graph.select(slot, F.lit(False).alias("text"), F.lit(None).cast(kind).alias("key"), "front", "seen", none.alias("carried"))
    reached = named.join(numbers, "id").groupBy(F.col(key).alias("key")).agg(F.collect_set("no").alias("front")).withColumn("seen", F.col("front"))
    found = None
    for hop in range(1, hops + 1):
        asks = reached.select("key", "front", "seen", F.pmod(F.xxhash64("key"), F.lit(salts)).alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
        asks = asks.select(slot, F.lit(True).alias("text"), "key", "front", "seen", F.when(F.col("slice") == 0, F.col("seen")).alias("carried") if hop < hops else none.alias("carried"))
        met = graph.unionByName(asks).repartitionById(slices * salts, "slot").sortWithinPartitions("slot", "text")
        met = met.mapInArrow(_spread(hop < hops), f"key {kind}, seen array<bigint>, fresh array<bigint>, entities bigint")
        met = met.groupBy("key").agg(F.flatten(F.collect_list("seen")).alias("seen"), F.flatten(F.collect_list("fresh")).alias("front"), F.sum("entities").alias("entities"))
        met = materialise(met.where("entities > 0"), "met")
        counts = met.select(F.col("key").alias(key), F.lit(hop).alias("hop"), "entities")
        found = counts if found is None else found.unionByName(counts)
        reached = met.select("key", "front", F.concat("seen", "front").alias("seen"))
    return found
