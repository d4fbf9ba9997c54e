"""Exact top-k search: tiles of candidates times blocks of queries, with a tree of merges.

Candidates are packed into tiles of TILE_ROWS rows and queries into blocks of BLOCK_ROWS rows.
Each tile carries one salt and each block goes to every salt, so an equi-join on the salt
brings each tile and block together once. The join is shuffled at every size: Spark's estimate
doesn't count the blocks' copies, and a broadcast of these passes through the driver. A task
multiplies matrices, selects the best of each tile and merges
them with what it has; two windows merge the tasks' lists.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.llm import batches

TILE_ROWS = 4096
BLOCK_ROWS = 2048
#: Query blocks whose lists a task holds at once.
HELD_BLOCKS = 64
#: Groups of tasks that the first window merges.
GROUPS = 32
SCALE = 1024

PACKED = "dim int, salt int, ids binary, wide boolean, cells binary"


def valid(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok, F.lit(False))


def packer(rows: int, salts: int):
    """A mapInArrow function: (vec_id, vector) to matrices of up to ``rows`` integer rows, by dimension."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        out = 0

        def emit(dim: int, whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal out
            ids = np.concatenate([x[0] for x in held[dim]])
            cells = np.concatenate([x[1] for x in held[dim]])
            n = len(ids) if whole else len(ids) // rows * rows
            held[dim] = [(ids[n:], cells[n:])]
            for i in range(0, n, rows):
                part, own = cells[i : i + rows], ids[i : i + rows]
                order = np.argsort(own, kind="stable")
                top = float(np.abs(part).max(initial=0))
                if top >= 2**62:
                    raise OverflowError("a scaled component does not fit a long")
                wide = top >= 2**31
                salt = (zlib.crc32(own.tobytes()) + out) % salts
                out += 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "dim": pa.array([dim], pa.int32()),
                        "salt": pa.array([salt], pa.int32()),
                        "ids": pa.array([own[order].astype("<i8").tobytes()], pa.binary()),
                        "wide": pa.array([wide]),
                        "cells": pa.array([part[order].astype("<i8" if wide else "<i4").tobytes()], pa.binary()),
                    }
                )

        for batch in parts:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            vectors = batch.column(1)
            dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                flat = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                cells = np.floor(SCALE * flat).reshape(len(own), int(dim))
                held.setdefault(int(dim), []).append((ids[own], cells))
                if sum(len(x[0]) for x in held[int(dim)]) >= rows:
                    yield from emit(int(dim), False)
        for dim in held:
            if sum(len(x[0]) for x in held[dim]):
                yield from emit(dim, True)

    return pack


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the k highest scores and their ids; ids ascend along a row's columns where scores tie."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
        room = k - (scores > kth).sum(axis=1, keepdims=True)
        tied = scores == kth
        keep = (scores > kth) | (tied & (np.cumsum(tied, axis=1) <= room))
        at = np.nonzero(keep)[1].reshape(len(scores), k)
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(np.broadcast_to(ids, keep.shape), at, 1)
    else:
        ids = np.broadcast_to(ids, scores.shape)
    return scores, ids


def scorer(k: int):
    """A mapInArrow function: joined (tile, block) rows to each query's best of this task."""

    def matrix(ids: bytes, wide: bool, cells: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.frombuffer(ids, "<i8")
        return own, np.frombuffer(cells, "<i8" if wide else "<i4").reshape(len(own), dim)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() % GROUPS
        least = -np.iinfo(np.int64).max  # its negative fits as well
        held: dict[bytes, tuple] = {}

        def rows(block: bytes) -> pa.RecordBatch:
            queries, scores, ids = held.pop(block)
            real = scores != least
            n = real.sum(axis=1)
            return pa.RecordBatch.from_pydict({"query_id": np.repeat(queries, n), "vec_id": ids[real], "score": scores[real], "part": np.full(n.sum(), group, np.int32)})

        for batch in parts:
            for r in batch.to_pylist():
                ids, cells = matrix(r["ids"], r["wide"], r["cells"], r["dim"])
                queries, wanted = matrix(r["q_ids"], r["q_wide"], r["q_cells"], r["dim"])
                top = float(np.abs(cells).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * r["dim"]
                if top >= 2**62:
                    raise OverflowError("a score does not fit a long")
                kind = np.float64 if top < 2**53 else np.int64  # either is exact; the first uses BLAS
                scores = (wanted.astype(kind) @ cells.astype(kind).T).astype(np.int64)
                scores[queries[:, None] == ids] = least
                scores, ids = best(scores, ids, k)
                block = r["q_ids"] + bytes([r["dim"] % 251])
                if block in held:
                    scores, ids = np.concatenate([held[block][1], scores], 1), np.concatenate([held[block][2], ids], 1)
                    order = np.argsort(ids, axis=1, kind="stable")
                    scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
                    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
                held[block] = (queries, scores, ids)
                if len(held) > HELD_BLOCKS:
                    yield rows(next(iter(held)))
        for block in list(held):
            yield rows(block)

    return score


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to smaller ids.

    Both tables have vec_id and embedding. Components become floor(1024 * x). Rows whose id or
    vector is null, or whose vector holds a null or non-finite component, take no part; vectors
    of another dimension are no candidates. A query is no candidate of its own; query ids that
    repeat are asked once, with their smallest vector, and repeated candidates are each ranked.
    An empty table gives no rows; fewer candidates than k give all.
    """
    spark = candidates.sparkSession
    batches.bound(spark)
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    usable = lambda df: df.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    tiles = usable(candidates).mapInArrow(packer(TILE_ROWS, salts), PACKED)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = asked.mapInArrow(packer(BLOCK_ROWS, 1), PACKED).select(
        F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("wide").alias("q_wide"), F.col("cells").alias("q_cells"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("q_salt")
    )
    pairs = tiles.join(blocks.hint("shuffle_merge"), (tiles["salt"] == blocks["q_salt"]) & (tiles["dim"] == blocks["q_dim"])).select("dim", "ids", "wide", "cells", "q_ids", "q_wide", "q_cells")
    lists = pairs.mapInArrow(scorer(k), "query_id long, vec_id long, score long, part int")
    order = [F.col("score").desc(), F.col("vec_id")]
    some = lists.withColumn("r", F.row_number().over(W.partitionBy("query_id", "part").orderBy(*order))).where(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


_SQL = """
with v as (
  select vec_id, [floor(1024 * x::double)::bigint for x in embedding] as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
q as (select vec_id, min(e) as e from v where vec_id % 100 = 0 group by 1),
s as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.e::double[], v.e::double[])::bigint as score
  from q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

QUERIES = {"op8_exact_top_k": op8_exact_top_k}
ORACLE_SQL = {"op8_exact_top_k": _SQL}
