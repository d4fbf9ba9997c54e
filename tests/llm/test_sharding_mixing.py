from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from provena.llm import mixing, sharding


def _shards(spark, rows, n):
    df = spark.createDataFrame(rows, "doc_id long, size long, source string, shard string")
    dims = {"source": sharding.text_order(F.col("source")), "size": sharding.number(F.col("size"))}
    out = sharding.kd_shards(df.withColumnRenamed("shard", "extra"), dims, F.col("size"), [F.col("doc_id"), F.col("extra")], n)
    return [r.asDict() for r in out.collect()]


def test_shards_hold_near_equal_bytes_and_gapless_slots(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(10, 4000), "hot" if i % 3 == 0 else f"s{i % 17}", "x") for i in range(6000)] + [(None, 50, None, None)]
    out = _shards(spark, rows, 13)
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(13))
    mean = sum(r[1] for r in rows) / 13
    for own in by.values():
        assert abs(sum(r["size"] for r in own) - mean) < 0.02 * mean
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


def test_shards_of_ties_repeats_and_nothing(spark):
    assert _shards(spark, [], 5) == []
    same = defaultdict(list)
    for r in _shards(spark, [(1, 10, "a", "b")] * 4000 + [(None, 10, None, None)] * 4000, 4):
        same[r["shard"]].append(r["slot"])
    assert sorted(same) == [0, 1, 2, 3] and all(abs(len(v) - 2000) <= 20 and sorted(v) == list(range(len(v))) for v in same.values())
    tied = _shards(spark, [(i, 10, "a", "b") for i in range(400)], 4)
    counts = defaultdict(int)
    for r in tied:
        counts[r["shard"]] += 1
    assert sorted(counts) == [0, 1, 2, 3] and max(counts.values()) - min(counts.values()) <= 8


def _check_cuts(rows, dims, widths, first, n):
    """Each node's two sides lie apart along its widest dimension, and share its bytes as its shards are shared."""
    if n == 1 or len(rows) < 2:
        return
    spread = [(max(r[d] for r in rows) - min(r[d] for r in rows)) / (widths[d] or 1.0) for d in dims]
    d = dims[max(range(len(dims)), key=lambda i: (spread[i], -i))]
    left, right = ([r for r in rows if (r["shard"] < first + n // 2) == side] for side in (True, False))
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["size"] for r in left) - total * (n // 2) / n) <= max(r["size"] for r in rows) + total / n * sharding.TOLERANCE
    assert not left or not right or max(r[d] for r in left) <= min(r[d] for r in right)
    _check_cuts(left, dims, widths, first, n // 2)
    _check_cuts(right, dims, widths, first + n // 2, n - n // 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_are_those_of_a_tree_over_the_widest_dimensions(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(1, 900), rng.choice([0.0, 1.0, rng.random()]), rng.gauss(0, 1) ** 3) for i in range(3000)] + [(7, 500, 1.0, 0.5)] * 1500
    df = spark.createDataFrame(rows, "doc_id long, size long, a double, b double")
    dims = ["a", "b"]
    out = sharding.kd_shards(df, {d: F.col(d) for d in dims}, F.col("size"), [F.col("doc_id")], 11)
    got = [r.asDict() for r in out.collect()]
    assert len(got) == len(rows)
    _check_cuts(got, dims, {d: max(r[d] for r in got) - min(r[d] for r in got) for d in dims}, 0, 11)


def test_target_bytes_sets_the_number_of_leaves(spark):
    df = spark.createDataFrame([(i, 100) for i in range(100)], "doc_id long, size long")
    out = sharding.kd_shards(df, {"d": sharding.number(F.col("doc_id"))}, F.col("size"), [F.col("doc_id")], target_bytes=2500)
    assert {r["shard"] for r in out.collect()} == {0, 1, 2, 3}


def test_op1_whole_table(spark):
    out = sharding.op1_kd_tree_shards(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert 0 <= r["shard"] < 40


def _plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target = float(sum(sizes.values())), dict.fromkeys(order, 0.0)
    live = set(order)
    while left > 1e-9 and live:
        share = left / sum(w[s] for s in live)
        left = 0.0
        for s in list(live):
            target[s] += share * w[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                live.discard(s)
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_agree_with_repeated_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 3, 50, 2000, 100000]) for i in range(9)} | {None: 70, "é": 10}
    df = spark.createDataFrame(list(sizes.items()), "__source string, source_size long")
    got = {r["__source"]: r["target"] for r in mixing.targets(df).collect()}
    for s, t in _plain_targets(sizes).items():
        assert math.isclose(got[s], t, rel_tol=1e-9, abs_tol=1e-6)


def _mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double, taken string")
    return mixing.mix(df.withColumnRenamed("taken", "extra"), F.col("source"), F.col("size"), F.col("doc_id"), F.col("quality"))


def test_mix_meets_targets_and_limits(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([0, 1, 7, 300, None]), rng.choice([0.5, 2.0, None]), "x") for i in range(3000)]
    rows += rows[:40] + [(None, "b", 12, 1.0, None)]
    one, two = (sorted(map(str, _mixed(spark, rows).collect())) for _ in range(2))
    assert one == two and len(one) == len(rows)
    by = defaultdict(list)
    for r in _mixed(spark, rows).collect():
        assert 0 <= r["taken"] <= 3 * (r["size"] or 0)
        by[r["source"]].append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        epochs = int(own[0]["target"] // own[0]["source_size"])
        assert all(r["taken"] >= epochs * (r["size"] or 0) for r in own)


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, "a", 10, 2.0 if i % 2 else 0.5, "x") for i in range(4000)] + [(10_000 + i, "b", 10, 1.0, "x") for i in range(4000)]
    taken = defaultdict(int)
    for r in _mixed(spark, rows).where("source = 'a'").collect():
        taken[r["quality"]] += r["taken"]
    assert taken[2.0] > 1.5 * taken[0.5] > 0


def test_mix_of_nothing(spark):
    assert _mixed(spark, []).count() == 0
    assert [r["taken"] for r in _mixed(spark, [(1, "a", 0, 1.0, "x"), (2, None, None, None, "x")]).collect()] == [0, 0]


def test_mixed_rows_repeat_whole_documents(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "en", "abc"[i % 3], 2) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in out.collect())
