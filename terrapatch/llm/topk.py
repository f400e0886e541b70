"""Exact top-k search: tiled matrix products of queries and shards.

Vectors become integer matrices, queries in tiles and candidates in shards.  Each tile meets
each shard once, by an equi-join on the shard's group; a task keeps the best of a tile over
all shards it meets, by partial selection, and the tasks' lists are merged per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapatch.llm import common

#: Vectors in a tile of queries and in a shard of candidates.
TILE, SHARD = 512, 4096
#: Numbers in one block of scores: bounds a task's memory.
BLOCK = "kind int, dim int, n int, ids binary, data binary"


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(1024 x), x as double; an exact integer held as double."""
    return np.floor(values.astype(np.float64) * 1024.0)


def _blocks(batches, kind: int, size: int):
    """Matrices of up to `size` valid vectors of one dimension each."""
    held: dict[tuple[int, int], list] = {}

    def pack(key):
        ids, data = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
        return pa.RecordBatch.from_pydict({"kind": pa.array([key[0]], pa.int32()), "dim": pa.array([key[1]], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "data": [data.astype("<f8").tobytes()]})

    for batch in batches:
        ids, vecs = batch.column(0), batch.column(1)
        ok = ids.is_valid().to_numpy(False) & vecs.is_valid().to_numpy(False)
        offs = vecs.offsets.to_numpy().astype(np.int64)
        flat = vecs.values.to_numpy(False).astype(np.float64)  # nulls become NaN
        good = np.isfinite(flat)
        bad = np.concatenate([[0], np.cumsum(~good)])
        ok &= bad[offs[1:]] == bad[offs[:-1]]
        number = ids.to_numpy(False)
        dims = np.diff(offs)
        for dim in np.unique(dims[ok]):
            at = np.flatnonzero(ok & (dims == dim))
            x = quantised(flat[offs[at][:, None] + np.arange(dim)])
            who = number[at].astype(np.int64)
            for a in range(0, len(who), size):
                held.setdefault((kind, int(dim)), []).append((who[a : a + size], x[a : a + size]))
                if sum(len(y[0]) for y in held[kind, int(dim)]) >= size:
                    yield pack((kind, int(dim)))
    for key in list(held):
        yield pack(key)


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles are exact while sums stay below 2**53; beyond, Python's integers, held within 64 bits."""
    if queries.size and shard.size and np.abs(queries).max() * np.abs(shard).max() * queries.shape[1] >= 2.0**53:
        exact = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object)
        return np.clip(exact(queries) @ exact(shard).T, -(2**63), 2**63 - 1).astype(np.int64)
    return (queries @ shard.T).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores, ties to the smaller id. A row's own vector has the id -1."""
    if scores.shape[1] > 4 * k:  # partial selection: all that reach the k-th score
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        width = int((scores >= floor[:, None]).sum(1).max())
        if width < scores.shape[1]:
            order = np.argsort(scores < floor[:, None], axis=1, kind="stable")[:, :width]
            ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k best candidates of each query (ids divisible by `every`) by integer inner product.

    Vectors that are null or hold a null or non-finite component take no part, nor do null ids; a vector meets
    only those of its own dimension. Rows with the query's id are its own; a repeated query counts once (its least vector), a
    repeated candidate each time. Fewer than k candidates: all of them. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    shards = common.written(rows.mapInArrow(lambda b: _blocks(b, 0, SHARD), BLOCK), "topk-shards")
    shards = shards.withColumn("at", F.monotonically_increasing_id())
    groups = max(1, shards.count())
    shards = shards.withColumn("g", F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int"))
    tiles = common.written(asked.mapInArrow(lambda b: _blocks(b, 1, TILE), BLOCK), "topk-tiles").select("dim", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    tiles = tiles.withColumn("tile", F.monotonically_increasing_id()).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = shards.join(tiles.hint("shuffle_merge"), ["g", "dim"]).select("tile", "dim", "qids", "qdata", "ids", "data").sortWithinPartitions("tile")

    def run(batches):
        now, best = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                tile, dim, qids, qdata, ids, data = (c[r].as_py() for c in batch.columns)
                if tile != now:
                    if best:
                        yield from emit(*best)
                    now, best = tile, None
                q = np.frombuffer(qids, "<i8")
                who = np.frombuffer(ids, "<i8")
                score = products(np.frombuffer(qdata, "<f8").reshape(len(q), dim), np.frombuffer(data, "<f8").reshape(len(who), dim))
                names = np.broadcast_to(who, score.shape)
                own = names == q[:, None]
                if own.any():
                    names, score = np.where(own, -(2**63), names), np.where(own, -(2**63), score)
                if best:
                    names, score = np.concatenate([best[1], names], 1), np.concatenate([best[2], score], 1)
                best = (q, *_best(names, score, k))
        if best:
            yield from emit(*best)

    def emit(q, names, score):
        keep = names != -(2**63)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, keep.sum(1))), pa.array(names[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    parts = met.mapInArrow(run, "query_id long, vec_id long, score long")
    top = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
