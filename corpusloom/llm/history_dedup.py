"""New batches against everything accepted before, by persisted inverted-file cells that hold full vectors.

A text becomes the vector of its folded words' counts, written as coordinates (word, k) for the k-th time it occurs; then
the L1 distance of two texts is |a| + |b| - 2 |a ∩ b|, and b repeats a if at least three quarters of the longer one's
coordinates lie in the other. Centroids found by clustering don't work here: unrelated texts are almost equally far from
each other, so no distance bound would ever rule out a cell. Cells are regions of the coordinate space instead: in each of
``CELLS`` random views a vector lies in the cell named by the three of its coordinates that come first in the view's order,
in which a coordinate comes early the more telling it is (consistent weighted sampling). How telling it is, is
fitted once on the first corpus: neither in most texts nor in almost none.

A batch reads the members of its own cells only, not the history. Cells list members in order of acceptance, and a query
reads on in a cell until no nearer match is possible: by rank (only the earliest match is wanted, so it stops where
members are later than the best match so far), by size (a vector shorter than three quarters of the other is too far
away) and by distance (members carry a 256-bit sketch, the parity of their coordinates by bit; sketches never differ
in more bits than the L1 distance). The first members that no bound rules out are reranked exactly by their full vectors,
and what a match repeats itself is looked at as well. Then the batch's vectors are appended; stored texts are never read again.

A cell is read in windows, so one of any size takes bounded memory, and a text with any number of near copies costs each
of them a few comparisons. Texts with equal words form one class with one place in the cells. Rows that come twice count once.
Null, empty and wordless texts are neither stored nor found; case, accents, markup and invisible characters don't matter
(see functions.words). Coordinates are 32-bit hashes: two texts are taken for nearer than they are by one word in about
one of a million pairs at the limit.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.words import words
from corpusloom.functions.workspace import materialise, path_exists, scratch_path, small_side

#: Share of the longer text's words that the other must hold.
SHARED = 0.75
#: Views, and coordinates that name a vector's cell in each.
CELLS, NAMED_BY = 20, 3
#: Counters of the table of rarities; it bounds what is broadcast.
COUNTERS = 1 << 20
#: Share of the texts that the most telling coordinates are in; the weight of one falls off on both sides. Every other view takes the
#: weights squared: the ones are selective, the others meet texts that have only common words in common.
TELLING, LEAST_WEIGHT = 1e-3, 0.7
#: Members of a cell that are held at a time, survivors of the bounds that a query takes from a cell at a time; both grow by rounds.
WINDOW, TAKEN, LARGEST_WINDOW = 4096, 8, 1 << 20
#: Pairs that are compared at a time.
PAIRS = 1 << 18
#: Up to so many cells or row ids of a batch are broadcast (8 bytes each) to restrict what is read; beyond, row ids are joined and all
#: cells are read, as a join would sort them by cell once more than the probing does.
FEW = 1_000_000
#: Up to so many cells or rows of a batch are looked up by value, so that row groups and pages are skipped.
VERY_FEW = 32
#: Batches that are accepted together in p2_found.
WAITING = 7
VECTOR = "rowid long, bag binary, size int, coords array<int>"
#: Words of 64 bits of a sketch.
SKETCH = ("first", "second", "third", "fourth")
MEMBER = f"cell long, rowid long, size int, {', '.join(f'{word} long' for word in SKETCH)}"
NEVER = -(1 << 62)
SHIFTED = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def coordinates(text: str | None) -> np.ndarray:
    """Sorted 32-bit coordinates of a text's words, one for each occurrence."""
    out = []
    for word, times in Counter(words(text)).items():
        out += [_coordinate(word, k) for k in range(1, times + 1)]
    return np.unique(np.array(out, np.uint32))


@lru_cache(1 << 19)
def _coordinate(word: str, k: int) -> int:
    return xxhash.xxh32_intdigest(f"{word} {k}")


def _first(values: np.ndarray) -> np.ndarray:
    """Whether each of sorted values is the first of its kind."""
    return np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def coordinates_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ``coordinates`` of many texts, one after the other, and how many each has."""
    numbers, lengths, flat = _Numbers(), [], []
    for text in texts:
        found = words(text)
        lengths.append(len(found))
        flat.extend(map(numbers.__getitem__, found))
    known, n = list(numbers), max(1, len(numbers))
    at = np.sort(np.repeat(np.arange(len(texts)), np.array(lengths, np.int64)) * n + np.array(flat, np.int64))  # text, then word
    place = np.arange(len(at))
    first = _first(at)
    text, word, time = at // n, at % n, place - np.maximum.accumulate(np.where(first, place, 0)) + 1
    coordinate = np.array([_coordinate(w, 1) for w in known], np.uint32)[word]
    more = np.flatnonzero(time > 1)
    again = pa.array(time[more] * n + word[more]).dictionary_encode()
    coordinate[more] = np.array([_coordinate(known[x % n], x // n) for x in again.dictionary.to_pylist()], np.uint32)[again.indices.to_numpy()]
    at = np.sort(text.astype(np.uint64) << np.uint64(32) | coordinate)
    at = at[_first(at)]
    return at.astype(np.uint32), np.bincount((at >> np.uint64(32)).astype(np.int64), minlength=len(texts))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, sizes = coordinates_of(batch["text"].to_pylist())
        ends, some = np.cumsum(sizes), sizes > 0
        plain = memoryview(flat.tobytes())
        bags = [xxhash.xxh3_128_digest(plain[4 * (end - size) : 4 * end]) for end, size in zip(ends[some].tolist(), sizes[some].tolist())]
        coords = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[some]]).astype(np.int32)), pa.array(flat.view(np.int32)))
        yield pa.RecordBatch.from_arrays([batch["rowid"].filter(pa.array(some)), pa.array(bags, pa.binary()), pa.array(sizes[some].astype(np.int32)), coords], ["rowid", "bag", "size", "coords"])


def vectorise(rows: DataFrame) -> DataFrame:
    """(rowid, bag, size, coords) of a table (rowid, text); rows delivered twice count once."""
    plain = rows.where("rowid is not null and text is not null").select(F.col("rowid").cast("long").alias("rowid"), "text")
    return plain.distinct().mapInArrow(_vectors, VECTOR)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def cells_of(flat: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The cells (rows by views) of vectors whose 32-bit coordinates lie one after the other in ``flat``."""
    encoded = pa.array(flat).dictionary_encode()  # a coordinate is drawn for once, however many vectors have it
    at, wide = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_numpy().astype(np.uint64)
    weights_of = np.empty(len(wide), np.float32)
    weights_of[at] = weights
    inverses = [(1 / weights_of**p).astype(np.float32) for p in (1, 2)]
    out = np.empty((len(starts), CELLS), np.uint64)
    for view in range(CELLS):
        shuffled = _mixed((wide + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((view + 1) * 0xA24BAED4963EE407 % 2**64))
        cell = np.full(len(starts), view, np.uint64)
        for k in range(NAMED_BY):  # positive floats sort like their bits: the least arrival, and with it the coordinate it belongs to
            arrival = SHIFTED[shuffled >> np.uint64(16 * k) & np.uint64(0xFFFF)] * inverses[view % 2]
            first = np.minimum.reduceat((arrival.view(np.uint32).astype(np.uint64) << np.uint64(32) | wide).take(at), starts)
            cell = _mixed(cell * np.uint64(31) ^ (first & np.uint64(0xFFFFFFFF)))
        out[:, view] = cell
    return out


def sketches(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words of each vector's sketch: the parity of its coordinates by the value of a hash."""
    bit = ((flat * np.uint32(0x9E3779B1)).astype(np.uint64) * np.uint64(64 * len(SKETCH))) >> np.uint64(32)
    one = np.uint64(1) << (bit & np.uint64(63))
    return tuple(np.bitwise_xor.reduceat(np.where((bit >> np.uint64(6)) == word, one, np.uint64(0)), starts) for word in range(len(SKETCH)))


class VectorCells:
    """Persisted ``vectors``, ``cells`` and ``links`` (a folder a batch) and the fitted ``rarity``, below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "cells")
        self._weights = None

    def _table(self, name: str, schema: str) -> DataFrame:
        if not path_exists(self.spark, f"{self.path}/{name}"):
            nothing = self.spark.range(0)  # createDataFrame would start Python workers for it
            return nothing.select(F.from_json(F.lit(None).cast("string"), schema).alias("row")).select("row.*")
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors", VECTOR)

    @property
    def cells(self) -> DataFrame:
        return self._table("cells", MEMBER)

    @property
    def links(self) -> DataFrame:
        """(kept_rowid, new_rowid) of everything found so far."""
        return self._table("links", "kept_rowid long, new_rowid long")

    def fit(self, vectors: DataFrame) -> "VectorCells":
        """Count the coordinates of a first corpus into ``COUNTERS`` counters, which say from then on how telling one is."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, rows = np.zeros(COUNTERS, np.int64), 0
            for batch in batches:
                coords = batch["coords"].flatten().to_numpy().view(np.uint32)
                counts += np.bincount(coords % np.uint32(COUNTERS), minlength=COUNTERS)
                rows += len(batch)
            slots = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1).astype(np.int32)), pa.array(np.append(counts[slots], rows))], ["slot", "n"])

        counters = vectors.select("coords").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        counters.write.mode("overwrite").parquet(f"{self.path}/rarity")
        return self

    def _shared_weights(self):
        if self._weights is None:
            table = self.spark.read.schema("slot int, n long").parquet(f"{self.path}/rarity").toArrow()
            slot, n = table["slot"].to_numpy(), table["n"].to_numpy()
            counts = np.full(COUNTERS, 0.5)
            counts[slot[slot >= 0]] = n[slot >= 0]
            rare, best = np.log(max(1, n[slot < 0].sum()) / counts), np.log(1 / TELLING)
            weights = np.maximum(np.minimum(rare, 2 * best - rare), LEAST_WEIGHT).astype(np.float32)
            self._weights = self.spark.sparkContext.broadcast(weights)
        return self._weights

    def _members(self, vectors: DataFrame) -> DataFrame:
        """(cell, rowid, size, sketch) of every cell that each vector lies in, sorted by cell."""
        shared = self._shared_weights()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                starts = batch["coords"].offsets.to_numpy()
                flat = batch["coords"].values.to_numpy()[starts[0] : starts[-1]].view(np.uint32)
                starts = starts[:-1] - starts[0]
                cells = cells_of(flat, starts, weights[flat % np.uint32(COUNTERS)])
                rest = [batch["rowid"].to_numpy(), batch["size"].to_numpy(), *(x.view(np.int64) for x in sketches(flat, starts))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells.view(np.int64).ravel(), *(np.repeat(c, CELLS) for c in rest))], ["cell", "rowid", "size", *SKETCH])

        return vectors.select("rowid", "size", "coords").mapInArrow(place, MEMBER).sortWithinPartitions("cell", "rowid")

    def _only(self, table: DataFrame, column: str, wanted: DataFrame, n: int) -> DataFrame:
        """Rows of ``table`` whose ``column`` is among the ``n`` of ``wanted``: by value if they are very few, else by a join."""
        if n <= VERY_FEW:
            found = F.lit(False)
            for (value,) in wanted.select(column).distinct().collect():
                found = found | (F.col(column) == value)
            return table.where(found)
        return table.join(F.broadcast(wanted) if n <= FEW else wanted, column, "left_semi")

    def load(self, rows: DataFrame) -> "VectorCells":
        """Append an accepted history (rowid, text) without looking for repeats in it; fit the rarities on a first one."""
        vectors, part = self._stored(rows)
        self._members(self._one_a_class(vectors)).write.parquet(f"{self.path}/cells/{part}")
        return self

    def _one_a_class(self, vectors: DataFrame) -> DataFrame:
        """The vectors without those that equal one of a smaller row id."""
        names = vectors.select("bag", "rowid")
        classes = names.groupBy("bag").agg(F.min("rowid").alias("first"), F.max("rowid").alias("last")).where("last > first")
        copies = materialise(names.join(classes, "bag").where("rowid > first").select("bag", "rowid"), "copies")
        return vectors.join(small_side(copies), ["bag", "rowid"], "left_anti")

    def _stored(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """The vectors of new rows, appended to the store, and the name of the folder they and what follows from them go to."""
        part = uuid.uuid4().hex
        vectorise(rows).write.parquet(f"{self.path}/vectors/{part}")
        vectors = self.spark.read.schema(VECTOR).parquet(f"{self.path}/vectors/{part}")
        if not path_exists(self.spark, f"{self.path}/rarity"):
            self.fit(vectors)
        return vectors, part

    def accept(self, rows: DataFrame) -> DataFrame:
        """(kept_rowid, new_rowid): each row of a batch (rowid, text) that repeats an earlier one, of the history or the batch,
        with the earliest it repeats. Row ids ascend in order of arrival. The batch is then part of the cells."""
        earlier, history, known = self.vectors, self.cells, self.links
        vectors, part = self._stored(rows)
        names = vectors.select("rowid", "bag")
        classes = names.groupBy("bag").agg(F.min("rowid").alias("query"))
        own = materialise(self._members(self._one_a_class(vectors)), "own")
        n = own.count()
        asks = own.withColumn("after", F.lit(NEVER))
        postings = (history if n > FEW else self._only(history, "cell", asks, n)).withColumn("after", F.lit(None).cast("long")).unionByName(asks)
        near, window, taken = None, WINDOW, TAKEN
        while n:
            met = materialise(self._probe(postings, window, taken), "met")
            now = self._rerank(met.where("member is not null").select(F.col("rowid").alias("query"), "member").distinct(), vectors, earlier)
            near = now if near is None else near.unionByName(now)
            best = near.groupBy(F.col("query").alias("rowid")).agg(F.min("member").alias("kept"))
            cut = met.where("after is not null").join(best, "rowid", "left").where("kept is null or after < kept")
            asks = materialise(cut.select(*own.columns, "after"), "asks")
            left, least = asks.agg(F.count("*"), F.min("after")).first()
            if not left:
                break
            window, taken = min(window * 16, LARGEST_WINDOW), taken * 8
            others = history.unionByName(own.join(asks, ["cell", "rowid"], "left_anti")).where(F.col("rowid") > least)
            postings = (others if left > FEW else self._only(others, "cell", asks.select("cell"), left)).withColumn("after", F.lit(None).cast("long")).unionByName(asks)
        while n:  # what a match repeats itself may be a match that the query met in no cell
            best = near.groupBy("query").agg(F.min("member").alias("kept"))
            m = near.count()
            told = self._only(known.withColumnRenamed("new_rowid", "member"), "member", near, m).select("member", F.col("kept_rowid").alias("onward"))
            told = told.unionByName(best.select(F.col("query").alias("member"), F.col("kept").alias("onward")))
            pairs = near.select("query", "member").join(told, "member").join(best, "query").where("onward < kept").select("query", F.col("onward").alias("member")).distinct()
            now = self._rerank(pairs, vectors, earlier)
            if now.isEmpty():
                break
            near = near.unionByName(now)
        near = near if n else self.spark.createDataFrame([], "query long, member long, same boolean")
        fresh = own.join(near.where("same").select(F.col("query").alias("rowid")), "rowid", "left_anti").select(*own.columns)
        fresh.sortWithinPartitions("cell", "rowid").write.parquet(f"{self.path}/cells/{part}")
        best = near.groupBy("query").agg(F.min("member").alias("kept"))
        kept = classes.join(best, "query", "left").select("bag", F.coalesce("kept", "query").alias("kept"))
        found = names.join(kept, "bag").where("kept < rowid").groupBy(F.col("rowid").alias("new_rowid")).agg(F.min("kept").alias("kept_rowid"))
        found.select("kept_rowid", "new_rowid").write.parquet(f"{self.path}/links/{part}")
        return self.spark.read.schema("kept_rowid long, new_rowid long").parquet(f"{self.path}/links/{part}")

    def _probe(self, postings: DataFrame, window: int, taken: int) -> DataFrame:
        """(rowid, member) of each row that asks (``after`` is set) and the first ``taken`` or more earlier members of its cell that lie
        behind ``after`` and within the cell's first ``window`` and that no bound rules out. Where more members follow, the row itself
        comes out too, with ``after`` the row id up to which the cell has been read for it.

        Cells are streamed in order of rank, so a cell of any size takes no more memory than ``window`` members.
        """
        fields = ["cell", "rowid", "size", *SKETCH]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell0, head, seen = None, None, 0  # the cell at the last batch's end, its first members, how many it had so far
            for batch in batches:
                if not len(batch):
                    continue
                columns = [batch[c].to_numpy() for c in fields] + [batch["after"].fill_null(NEVER).to_numpy(), batch["after"].is_valid().to_numpy(zero_copy_only=False)]
                skip = extra = 0
                if columns[0][0] == cell0:
                    skip, extra = len(head[0]), seen - len(head[0])
                    columns = [np.concatenate(x) for x in zip(head, columns)]
                cell, row, size, *sketch, after, asking = columns
                at = np.arange(len(cell))
                start = np.maximum.accumulate(np.where(_first(cell), at, 0))
                rank = at - start + np.where(start == 0, extra, 0)
                ask = np.flatnonzero(asking & (rank > 0) & (at >= skip))
                cut = np.where(rank > window, start + window - 1, -1)  # the member up to which the cell is read, if more follow
                count, end = np.zeros(len(cell), np.int64), np.minimum(rank, window)
                queries, members, j, width = [], [], 0, taken
                while len(ask):  # the next members of all cells, more and more of them
                    for part in np.split(ask, range(max(1, PAIRS // width), len(ask), max(1, PAIRS // width))):
                        many = np.minimum(end[part], j + width) - j
                        one = np.repeat(part, many)
                        other = np.arange(len(one)) + np.repeat(start[part] + j - np.cumsum(many) + many, many)
                        a, b = size[one], size[other]
                        least = np.ceil(SHARED * np.maximum(a, b) - 1e-9).astype(np.int32)
                        ok = np.flatnonzero(np.minimum(a, b) >= least)
                        one, other, most = one[ok], other[ok], (a + b - 2 * least)[ok]
                        apart = sum(np.bitwise_count((word[one] ^ word[other]).view(np.uint64)).astype(np.int16) for word in sketch)
                        ok = np.flatnonzero(apart <= most)
                        one, other = one[ok], other[ok]
                        ok = (row[other] < row[one]) & (row[other] > after[one])
                        queries.append(row[one[ok]]), members.append(row[other[ok]])
                        count += np.bincount(one[ok], minlength=len(count)) if ok.any() else 0
                    j += width
                    more = end[ask] > j
                    full = ask[(count[ask] >= taken) & (rank[ask] > j)]
                    cut[full] = start[full] + np.minimum(j, end[full]) - 1
                    ask, width = ask[more & (count[ask] < taken)], width * 4
                cut = np.where(asking & (at >= skip), cut, -1)
                behind = np.flatnonzero(cut >= 0)
                n = sum(map(len, queries))
                rest = [np.concatenate([np.zeros(n, x.dtype), x[behind]]) for x in (cell, size, *sketch)]
                query = np.concatenate([*queries, row[behind]])
                member = np.concatenate([*members, np.zeros(len(behind), np.int64)])
                reached = np.concatenate([np.zeros(n, np.int64), np.maximum(row[cut[behind]], after[behind])])
                found = np.arange(len(query)) < n
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rest[0], query, *rest[1:])] + [pa.array(member, mask=~found), pa.array(reached, mask=found)], [*fields, "member", "after"])
                last = start[-1]
                cell0, seen = cell[-1], int(rank[-1]) + 1
                head = [x[last : last + window] for x in columns]

        ordered = postings.repartition("cell").sortWithinPartitions("cell", "rowid")
        return ordered.mapInArrow(scan, f"{MEMBER}, member long, after long")

    def _rerank(self, pairs: DataFrame, vectors: DataFrame, earlier: DataFrame) -> DataFrame:
        """(query, member, same) of the pairs of which the smaller vector holds enough of the larger, by their full vectors; ``same``
        if they are equal. Queries are of the batch (``vectors``), members of the batch or ``earlier``."""
        pairs = materialise(pairs, "pairs")
        wanted = pairs.select(F.col("member").alias("rowid"))
        full = self._only(earlier.unionByName(vectors).select("rowid", "coords"), "rowid", wanted, pairs.count())
        joined = pairs.join(vectors.select(F.col("rowid").alias("query"), F.col("coords").alias("a")), "query")
        joined = joined.join(full.select(F.col("rowid").alias("member"), F.col("coords").alias("b")), "member")
        longer, shared = F.greatest(F.size("a"), F.size("b")), F.size(F.array_intersect("a", "b"))
        near = joined.select("query", "member", longer.alias("longer"), shared.alias("shared"))
        return materialise(near.where(F.col("shared") >= SHARED * F.col("longer")).select("query", "member", (F.col("shared") == F.col("longer")).alias("same")).distinct(), "near")


def p2_found(spark: SparkSession, sf_dir: str, waiting: int = WAITING) -> DataFrame:
    """Arriving chunks whose content repeats that of an earlier row, with the earliest: (kept_rowid, new_rowid).

    The history is loaded once; then batches are held against what has been accepted so far in order of their numbers (rows without
    one last), as many at a time as are ``waiting``. The result is the same for any number.
    """
    def read(table):
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")

    columns = F.col("chunk_rowid").alias("rowid"), F.col("content").alias("text")
    cells = VectorCells(spark).load(read("chunks").select(*columns))
    arrivals = read("chunk_batches").select(*columns, "batch_no")
    numbers = sorted((r[0] for r in arrivals.select("batch_no").distinct().collect()), key=lambda x: (x is None, x))
    for k in range(0, len(numbers), waiting):
        some = numbers[k : k + waiting]
        due = F.col("batch_no").isin([x for x in some if x is not None]) | (F.col("batch_no").isNull() if None in some else F.lit(False))
        cells.accept(arrivals.where(due).select("rowid", "text"))
    return cells.links
