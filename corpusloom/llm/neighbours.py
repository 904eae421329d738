"""The k nearest vectors of every vector, by forests of random-projection trees.

A trunk, one tree fitted on a bounded sample, sends every vector to the cell it falls into and, as a query, to the
cells beyond the nearest cutting planes as well, taken in order from a priority queue of margins while a margin is
smaller than the distance within which neighbours are expected. Each cell grows its own forest over its members; a
query takes leaves from all its trees through one shared priority queue, and the leaves' vectors are ranked again by
exact squared distance in double precision. Cells hold about ``cell`` vectors, up to 25 million vectors in all; beyond
that ``SAMPLE`` has to grow, or cells do. Each cell is a task of its own; vectors are shuffled once per cell they visit, not once per tree.

Rows whose vector is null, of another length, not finite or all zero are left out; an id that comes twice counts
once (with different vectors: the least). Ids with exactly equal vectors form one class, represented by its least id:
neighbours are sought among representatives, and every other member is linked to its representative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.workspace import materialise

#: Vectors of a cell; sample rows for each cell the trunk is fitted on, and for all of them.
CELL, SAMPLE_PER_CELL, SAMPLE = 8192, 128, 400_000
#: Trees of a cell's forest, vectors of a leaf, leaves a query takes, and further cells it visits at most.
TREES, LEAF, POPS, VISITS = 4, 96, 10, 3
#: Relative error that float arithmetic may leave in a distance: candidates within it of the last one kept are kept as well.
SLACK = 1e-5
#: Up to so many deliveries of one id are left for its cell to sort out; more are merged before anything is routed.
FEW_TIMES = 16
Tree = tuple[np.ndarray, np.ndarray]


def grow(x: np.ndarray, depth: int, rng: np.random.Generator, gap: float = 0.0) -> tuple[Tree, np.ndarray]:
    """A complete tree of ``depth`` levels over the rows of ``x``, and the leaf of each row.

    Each node cuts across the line between two of its vectors, at the median of the projections or, with ``gap``,
    in the widest gap within that share of the ranks around it. Unit directions and offsets are in heap order.
    """
    n, dim = x.shape
    planes, offsets = np.zeros((max(1, 2**depth - 1), dim), np.float32), np.zeros(max(1, 2**depth - 1), np.float32)
    order, bounds = np.arange(n), [(0, n)]
    for level in range(depth):
        following = []
        for k, (a, b) in enumerate(bounds):
            node = 2**level - 1 + k
            rows = order[a:b]
            if b - a < 2:
                following += [(a, b), (b, b)]
                continue
            one, two = x[rows[rng.integers(b - a)]], x[rows[rng.integers(b - a)]]
            line = one - two
            for _ in range(2 if gap else 0):  # a few steps towards two groups
                side = x[rows] @ line > ((one + two) / 2) @ line
                if 0 < side.sum() < b - a:
                    one, two = x[rows[side]].mean(0), x[rows[~side]].mean(0)
                    line = one - two
            length = np.linalg.norm(line)
            line = line / length if length > 0 else rng.standard_normal(dim).astype(np.float32) / np.float32(dim**0.5)
            at = x[rows] @ line
            ranked = np.argsort(at, kind="stable")
            at, cut = at[ranked], (b - a) // 2
            reach = int((b - a) * gap)
            if reach > 4:
                lo, hi, step = cut - reach, cut + reach, max(1, reach // 8)
                wide = at[lo + step : hi + step] - at[lo:hi]
                cut = lo + int(np.argmax(wide)) + step // 2
            planes[node], offsets[node] = line, (at[cut - 1] + at[cut]) / 2
            order[a:b] = rows[ranked]
            following += [(a, a + cut), (a + cut, b)]
        bounds = following
    leaf = np.empty(n, np.int32)
    for k, (a, b) in enumerate(bounds):
        leaf[order[a:b]] = k
    return (planes, offsets), leaf


def probe(trees: list[Tree], depth: int, x: np.ndarray, pops: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves that each row of ``x`` takes from the shared queue of all trees, and their priorities.

    Leaf numbers run through the trees. The first of each tree is the one the row falls into, at priority 0; the
    rest follow by the largest margin on their path.
    """
    n, size, leaves = len(x), 2**depth - 1, 2**depth
    if depth == 0:
        return np.tile(np.arange(len(trees), dtype=np.int32), (n, 1)), np.zeros((n, len(trees)), np.float32)
    margins = x @ np.concatenate([t[0] for t in trees]).T - np.concatenate([t[1] for t in trees])
    pops = max(len(trees), min(pops, len(trees) * leaves))
    waiting = np.full((n, pops * depth), np.inf, np.float32)
    node_of = np.zeros((n, pops * depth), np.int32)
    rows, column = np.arange(n), 0
    out, priority = np.zeros((n, pops), np.int32), np.zeros((n, pops), np.float32)
    for p in range(pops):
        if p < len(trees):
            tree, node, first = np.full(n, p), np.zeros(n, np.int64), np.zeros(n, np.float32)
        else:
            best = np.argmin(waiting[:, :column], axis=1)
            first, code = waiting[rows, best], node_of[rows, best]
            waiting[rows, best] = np.inf
            tree, node = code // (2 * size + 1), code % (2 * size + 1)
        for _ in range(depth):
            inner = node < size
            margin = margins[rows, tree * size + np.where(inner, node, 0)]
            right = margin > 0
            waiting[:, column] = np.where(inner, np.maximum(first, np.abs(margin)), np.inf)
            node_of[:, column] = tree * (2 * size + 1) + 2 * node * inner + 1 + ~right
            node = np.where(inner, 2 * node + 1 + right, node)
            column += 1
        out[:, p], priority[:, p] = tree * leaves + (node - size), first
    return out, priority


def nearest(members: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, seed: int, pops: int = POPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, squared distance) of the nearest members that a forest over ``members`` finds for each query.

    ``own``: the member each query is itself, or -1. Members at the k-th distance are all kept.
    """
    m, n = len(members), len(queries)
    rng = np.random.default_rng(seed)
    per_leaf, reranked = k + 3, 2 * k + 4
    depth = max(0, int(np.ceil(np.log2(m / max(LEAF, 8 * k)))))
    grown = [grow(members, depth, rng) for _ in range(TREES if depth else 1)]
    taken, priority = probe([t for t, _ in grown], depth, queries, pops)
    p, leaves = taken.shape[1], 2**depth
    norms = np.einsum("ij,ij->i", members, members)
    found = np.full((n * p, per_leaf), -1, np.int32)
    apart = np.full((n * p, per_leaf), np.inf, np.float32)
    more: list[tuple[np.ndarray, np.ndarray]] = []  # (query, member) beyond those places: ties with the last
    flat = np.where(np.isfinite(priority), taken, -1).ravel()
    by_leaf = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[by_leaf], np.arange(len(grown) * leaves + 1))
    for t, (_, leaf) in enumerate(grown):
        inside = np.argsort(leaf, kind="stable")
        ends = np.searchsorted(leaf[inside], np.arange(leaves + 1))
        for c in range(leaves):
            pairs, rows = by_leaf[starts[t * leaves + c] : starts[t * leaves + c + 1]], inside[ends[c] : ends[c + 1]]
            if not len(pairs) or not len(rows):
                continue
            who = pairs // p
            d = norms[rows] - 2 * (queries[who] @ members[rows].T)
            d[own[who][:, None] == rows] = np.inf
            keep = min(per_leaf, len(rows))
            near = np.argpartition(d, keep - 1, axis=1)[:, :keep]
            found[pairs, :keep], apart[pairs, :keep] = rows[near], np.take_along_axis(d, near, 1)
            edge = np.partition(apart[pairs, :keep], min(k, keep) - 1, axis=1)[:, min(k, keep) - 1]
            tied = d <= (edge + SLACK * (np.abs(edge) + norms[rows].max()))[:, None]
            crowded = tied.sum(1) > keep
            if crowded.any():
                a, b = np.nonzero(tied[crowded])
                more.append((who[crowded][a], rows[b]))
    found, apart = found.reshape(n, -1), apart.reshape(n, -1)
    order = np.argsort(found, axis=1, kind="stable")  # a member met in several leaves counts once
    found, apart = np.take_along_axis(found, order, 1), np.take_along_axis(apart, order, 1)
    apart[:, 1:][found[:, 1:] == found[:, :-1]] = np.inf
    keep = min(reranked, found.shape[1])
    near = np.argpartition(apart, keep - 1, axis=1)[:, :keep]
    edge = np.partition(apart, min(k, keep) - 1, axis=1)[:, min(k, keep) - 1]
    tied = (apart <= (edge + SLACK * (np.abs(np.where(np.isfinite(edge), edge, 0)) + norms.max(initial=0)))[:, None]) & np.isfinite(apart)
    crowded = np.flatnonzero(tied.sum(1) > keep)
    if len(crowded):
        a, b = np.nonzero(tied[crowded])
        more.append((crowded[a], found[crowded[a], b]))
    found, apart = np.take_along_axis(found, near, 1), np.take_along_axis(apart, near, 1)
    query, slot = np.nonzero(np.isfinite(apart) & (found >= 0))
    member = found[query, slot]
    if more:
        both = np.unique(np.concatenate([query * m + member, *(a.astype(np.int64) * m + b for a, b in more)]))
        query, member = both // m, both % m
    exact = np.empty(len(query))
    for a in range(0, len(query), 65536):
        difference = members[member[a : a + 65536]].astype(np.float64) - queries[query[a : a + 65536]].astype(np.float64)
        exact[a : a + 65536] = np.einsum("ij,ij->i", difference, difference)
    order = np.lexsort((exact, query))
    query, member, exact = query[order], member[order], exact[order]
    first = np.searchsorted(query, np.arange(n))
    last = np.minimum(first + k, np.searchsorted(query, np.arange(n), "right")) - 1
    within = exact <= exact[np.maximum(last, 0)][query] if len(query) else np.zeros(0, bool)
    return query[within], member[within], exact[within]


def valid_vector(embedding: Column, dim: int) -> Column:
    usable = F.forall(embedding, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(embedding) == dim) & usable & F.exists(embedding, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def expected_radius(sample: np.ndarray, k: int, rng: np.random.Generator) -> float:
    """A distance within which nearly all vectors have k neighbours: the 98th percentile in the (sparser) sample."""
    some = sample[rng.choice(len(sample), min(512, len(sample)), replace=False)].astype(np.float64)
    d = np.sort((some**2).sum(1)[:, None] + (sample.astype(np.float64) ** 2).sum(1) - 2 * some @ sample.T.astype(np.float64), axis=1)
    return float(np.sqrt(max(0.0, np.quantile(d[:, min(k, d.shape[1] - 1)], 0.98))))


def nearest_vectors(vectors: DataFrame, *, k: int = 5, dim: int = 64, cell: int = CELL, visits: int = VISITS) -> tuple[DataFrame, DataFrame]:
    """Neighbours among representatives and membership of exact copies, of a table with columns id and embedding.

    Returns (id, neighbour, distance), squared and exact, with every neighbour to which fewer than ``k`` are strictly
    nearer among those found, and (representative, id) of the members that are not representatives.
    The trunk is fitted on at most ``SAMPLE`` rows; every row is indexed and every row is a query.
    """
    usable = vectors.where("id is not null").where(valid_vector(F.col("embedding"), dim)).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    hashed = usable.select("id", F.xxhash64("embedding").alias("h"))
    ids = materialise(hashed.groupBy("id").agg(F.min("h").alias("h"), F.max("h").alias("other"), F.count("*").alias("times")), "ids")
    total, times, conflicts, vectors_seen = ids.agg(F.count("*"), F.max("times"), F.bool_or(F.col("h") != F.col("other")), F.count_distinct("h")).first()
    members = None
    if total and (times > FEW_TIMES or conflicts or vectors_seen < total):
        if conflicts:
            usable = usable.groupBy("id").agg(F.min("embedding").alias("embedding"))
        classes = materialise(usable.groupBy("embedding").agg(F.min("id").alias("id"), F.max("id").alias("last")), "classes")
        copies = classes.where("id <> last").select(F.col("id").alias("representative"), "embedding")
        members = usable.join(copies, "embedding").where("id <> representative").select("representative", "id").distinct()
        usable = classes.select("id", "embedding")
    cells = max(1, total // cell)
    depth = min(int(np.ceil(np.log2(cells))), int(np.log2(max(1, SAMPLE // SAMPLE_PER_CELL))))  # each plane rests on a fair sample
    wanted = min(SAMPLE, max(4 * cell, SAMPLE_PER_CELL * 2**depth))
    rng = np.random.default_rng(7)
    trunk, radius = None, 0.0
    if depth:
        drawn = usable.sample(min(1.0, wanted / total), seed=7).select("embedding").limit(2 * wanted).toArrow()
        sample = np.unique(matrix(drawn["embedding"], dim), axis=0)
        trunk, _ = grow(sample, depth, rng, gap=0.15)
        radius = expected_radius(sample, k, rng)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((trunk, radius))

    def route(batches):
        tree, reach = shared.value
        for batch in batches:
            x = matrix(batch["embedding"], dim)
            for a in range(0, len(x), 4096):
                part = batch.slice(a, 4096)
                if tree is None:
                    row, home, where = np.arange(len(part)), np.ones(len(part), bool), np.zeros(len(part), np.int32)
                else:
                    taken, priority = probe([tree], depth, x[a : a + 4096], 1 + visits)
                    row, slot = np.nonzero(priority <= reach)
                    home, where = slot == 0, taken[row, slot]
                again = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), pa.array(home), part["id"].take(again), part["embedding"].take(again)], ["cell", "home", "id", "embedding"]
                )

    def search(key, table):
        _, first = np.unique(table["id"].to_numpy(), return_index=True)  # rows delivered twice count once
        table = table.take(pa.array(np.sort(first)))
        home = table["home"].to_numpy()
        x, names = matrix(table["embedding"], dim), table["id"].combine_chunks()
        at = np.flatnonzero(home)
        own = np.full(len(x), -1)
        own[at] = np.arange(len(at))
        if not len(at):
            return pa.table({"id": pa.array([], pa.string()), "near": pa.array([], pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.string())])))})
        query, member, distance = nearest(x[at], x, own, k, seed=int(key[0].as_py()))
        offsets = np.searchsorted(query, np.arange(len(x) + 1)).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(distance), names.take(pa.array(at[member]))], ["distance", "id"]))
        return pa.table({"id": names, "near": near})

    routed = usable.mapInArrow(route, "cell int, home boolean, id string, embedding array<float>")
    tasks = max(spark.sparkContext.defaultParallelism, 2**depth)
    found = routed.repartitionById(tasks, F.col("cell")).groupBy("cell").applyInArrow(search, "id string, near array<struct<distance:double,id:string>>")
    merged = found.where(F.size("near") > 0).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    within = F.filter("near", lambda x: x["distance"] <= F.get("near", F.least(F.size("near"), F.lit(k)) - 1)["distance"])
    pairs = merged.select("id", F.explode(within).alias("near")).select("id", F.col("near.id").alias("neighbour"), "near.distance")
    return pairs, members if members is not None else spark.createDataFrame([], "representative string, id string")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids (id_a < id_b) of which one is among the 5 nearest of the other."""
    pairs, members = nearest_vectors(spark.read.parquet(f"{sf_dir}/chunk_vectors.parquet").select("id", "embedding"))
    links = pairs.select("id", "neighbour").union(members)
    return links.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
