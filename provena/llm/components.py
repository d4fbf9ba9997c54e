"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm import scratch

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Each edge points from the larger to the smaller end.
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = edges.join(least, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (a, b) of two longs; component is its smallest reachable id.

    Loops and repeated edges don't matter; rows with a null end are ignored; no edges give no
    rows. Each round is written to the shared folder; the edges shrink to stars in about log n
    rounds. A hub's edges meet only in a minimum, which is partly aggregated before it is
    shuffled, and in a join that adaptive execution splits.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = scratch.materialize(now, "edges"), None
    for _ in range(MAX_ROUNDS):
        new = scratch.materialize(_small_star(_large_star(now)), "edges")
        scratch.drop(now)
        now = new
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
