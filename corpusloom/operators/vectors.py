"""Exact nearest neighbours by squared L2 distance in double precision, and upkeep of a vector table.

Rows whose vector is null or of another length are never stored nor found. Ties at the k-th place are settled by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.workspace import materialise

#: Queries of a block; it bounds what is broadcast at a time.
BLOCK = 4096


def storable(rows: DataFrame, embedding: str, dim: int) -> DataFrame:
    return rows.where((F.size(embedding) == dim) & ~F.exists(embedding, lambda v: v.isNull() | F.isnan(v)))


def squared_l2(embedding: Column, vector: list[float]) -> Column:
    other = F.array(*[F.lit(float(v)) for v in vector])
    return F.aggregate(F.zip_with(embedding, other, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, vector: list[float], k: int, key: str = "vec_id", embedding: str = "embedding", where: Column | None = None) -> DataFrame:
    """(key, distance) of the k nearest rows to one vector; a filter is applied before any distance is computed."""
    candidates = storable(rows if where is None else rows.where(where), embedding, len(vector))
    return candidates.select(key, squared_l2(F.col(embedding), vector).alias("distance")).orderBy("distance", key).limit(k)


def nearest_of_each(queries: DataFrame, rows: DataFrame, k: int, dim: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, key, distance, rank) of the k nearest rows to each of a set of queries, itself excluded.

    Queries are taken in broadcast blocks; every task ranks its own rows for a block and passes on k per query,
    which a grouped aggregate merges.
    """
    spark = rows.sparkSession
    usable = storable(rows, embedding, dim).select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v"))
    asked = storable(queries, embedding, dim).select(F.col(key).cast("long").alias("query_id"), F.col(embedding).alias("v"))
    n = asked.count()
    parts = None
    blocks = 1 if n <= BLOCK else -(-3 * n // (2 * BLOCK))  # by hash, so two thirds full on average
    numbered = materialise(asked.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries") if blocks > 1 else asked.withColumn("_b", F.lit(0))
    for b in range(blocks):
        block = numbered.where(F.col("_b") == b).select("query_id", "v").toArrow()
        ids, q = block["query_id"].to_numpy(), np.array(block["v"].to_pylist(), np.float64).reshape(-1, dim)
        shared = spark.sparkContext.broadcast((ids, q))

        def rank(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                own = batch["id"].to_numpy()
                if not len(own) or not len(ids):
                    continue
                x = batch["v"].flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                d = np.stack([((x - one) ** 2).sum(1) for one in q])
                d[ids[:, None] == own] = np.inf
                keep = min(k + 1, len(own))
                near = np.argpartition(d, keep - 1, axis=1)[:, :keep]
                edge = np.take_along_axis(d, near, 1).max(1)
                query, at = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(own[at]), pa.array(d[query, at])], ["query_id", "id", "distance"])

        found = usable.mapInArrow(rank, "query_id long, id long, distance double")
        parts = found if parts is None else parts.unionByName(found)
    ranked = parts.withColumn("rank", F.expr("row_number() over (partition by query_id order by distance, id)").cast("long"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("id").alias(key), "distance", "rank")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The vectors that are left after those of some chunks or files are deleted."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
