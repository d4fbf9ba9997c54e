from __future__ import annotations

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.llm import components, jaccard, membership, neardup, shingles, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1300)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)] + [(7, 7), (8, 9), (8, 9)]
    want = _components({x for e in edges for x in e}, edges)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e for e in edges if e[0] != e[1])}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _set(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def _plain_link(rows, width, num, den):
    sets = [(i, _set(t, width)) for i, t in rows]
    links, edges = defaultdict(int), []
    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            o = len(a & b)
            if a and b and den * o >= num * (len(a) + len(b) - o):
                links[x] += 1
                links[y] += 1
                edges.append((x, y))
    of = _components(range(len(sets)), edges)
    least = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[of[x]].append(i)
    return sorted((str(i), len(s), str(min(least[of[x]], default=None)), links[x]) for x, (i, s) in enumerate(sets))


def _family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width, num, den", [(3, 90, 100), (5, 8, 10), (2, 1, 2)])
def test_links_equal_all_pairs(spark, monkeypatch, width, num, den):
    rng = random.Random(width)
    texts = []
    for k in range(6):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([12, 60, 150]))]
        texts += _family(rng, base, 40, 6 + k)
    shared = " ".join(f"common{i}" for i in range(55))
    texts += [f"{' '.join(f'u{rng.randint(0, 10**6)}' for _ in range(30))} {shared}" for _ in range(50)]
    texts += ["", None, "   \n", "one", "One", "two words", "A b", "a B", "x " * 3000, "x " * 2999] + texts[:30]
    rows = [(i if i % 37 else None if i == 37 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n long, uid string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in jaccard.link(df, width, num, den).collect())
    assert got == _plain_link(rows, width, num, den)


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_classes_larger_than_a_chunk(spark, monkeypatch, held):
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", held)
    rng = random.Random(4)
    rows = list(enumerate(_family(rng, [f"w{i}" for i in range(80)], 150, 7)))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect())
    assert got == _plain_link(rows, 3, 80, 100)


def test_no_documents_have_no_links(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link(empty, 3, 90, 100).count() == 0
    assert jaccard.one_of_each(empty).count() == 0


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_one_of_each(spark, monkeypatch, held):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", held)
    a, b = "a b c d e f g h i j k l m n o p q r s t", "z y x w v u t s r q p o n m"
    rows = [(4, a, "x"), (2, a, "y"), (9, b, "z"), (9, b, "z"), (11, "", "e"), (12, None, "e")]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(2, "y"), (9, "z"), (11, "e"), (12, "e")]


def test_words_are_hashed_alike_in_any_slice(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abÄé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 300))).encode() for _ in range(60)]
    want = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "SLICE_BYTES", 700)
    for a, b in zip(want, shingles.word_hashes(texts), strict=True):
        assert np.array_equal(a, b)
    assert [len(w) for w in want] == [len(WORD.findall(t.decode())) for t in texts]
    assert np.array_equal(shingles.word_hashes([b"A\x0bB\xc2\xa0c"])[0], shingles.word_hashes([b"a b\xc2\xa0C"])[0])


def _vectors(rng, n):
    base = rng.standard_normal((6, 16))
    x = base[rng.integers(0, 6, n)] + rng.standard_normal((n, 16)) * rng.choice([0.02, 0.15, 0.6], (n, 1))
    rows = [(int(i), [float(v) for v in np.float32(r)], int(i) % 3 if i % 11 else None) for i, r in enumerate(x)]
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, [1.0, 2.0], 1), (n + 5, [2.0, 4.0], 1)]
    return rows + rows[:5] + [(n + 6, rows[3][1], rows[3][2]), (n + 7, rows[3][1], rows[3][2])]


def _plain_near(rows, similar):
    ok = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links, edges = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(a):
            (_, v, x), (_, w, y) = rows[a], rows[b]
            if ok[a] and ok[b] and x == y and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= similar:
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
    of = _components(range(len(rows)), edges)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[of[k]].append(r[0])
    return sorted((r[0], links[k], min(least[of[k]]), r[0] == min(least[of[k]])) for k, r in enumerate(rows))


def test_near_duplicates_equal_all_pairs_in_one_block(spark):
    rows = _vectors(np.random.default_rng(7), 400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, neardup.near_duplicates(df, 0.93).collect())) == _plain_near(rows, 0.93)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_small_blocks_find_nearly_all_and_nothing_else(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((150, 16))
    x = np.repeat(base, 3, axis=0) + rng.standard_normal((450, 16)) * 0.06
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = {r[0]: r for r in _plain_near(rows, 0.93)}
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df, 0.93, block=48, window=16).collect()}
    assert all(got[i]["n_links"] <= want[i][1] for i in want)
    assert sorted(map(tuple, neardup.near_duplicates(df, 0.93, block=48, exact=True).collect())) == sorted(want.values())
    assert sum(got[i]["n_links"] for i in want) >= 0.9 * sum(w[1] for w in want.values())


@pytest.mark.parametrize("bytes_of_chunk, block", [(8 << 20, 48), (64 * 16 * 8, 10**6)])
def test_groups_of_many_blocks_keep_all_links(spark, monkeypatch, bytes_of_chunk, block):
    monkeypatch.setattr(neardup, "CHUNK_BYTES", bytes_of_chunk)
    monkeypatch.setattr(neardup, "TILE", (7, 20))
    rng = np.random.default_rng(9)
    group = rng.standard_normal(16) + rng.standard_normal((300, 16)) * 0.2
    spread = rng.standard_normal((100, 16)) * 0.75 + rng.standard_normal(16)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(np.concatenate([group, spread]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93, block=block)
    assert sorted(map(tuple, got.collect())) == _plain_near(rows, 0.93)


def _recall(spark, x):
    """The share of links found with the shipped blocks, among vectors of one label."""
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(int((u[at : at + 500] @ u.T >= 0.93).sum()) for at in range(0, len(u), 500)) - len(u)
    found = sum(r["n_links"] for r in neardup.near_duplicates(df, 0.93).select("n_links").collect())
    return found / want


def test_a_group_larger_than_the_default_block_keeps_all_links(spark):
    rng = np.random.default_rng(10)
    assert _recall(spark, np.float32(rng.standard_normal(32) + rng.standard_normal((20_000, 32)) * 0.2).astype(float)) == 1


@pytest.mark.parametrize("shift", [0.0, 2.0])
def test_planted_pairs_in_a_label_larger_than_the_default_block(spark, shift):
    """Pairs of cosine about 0.95 beyond what all share, among vectors with a mean and without."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((10_000, 64))
    near = base + rng.standard_normal(base.shape) * 0.3
    assert _recall(spark, np.concatenate([base, near]) + shift * rng.standard_normal(64) / 8) > 0.98


def test_top_k_broadcasts_no_blocks(spark):
    """Each block goes to every salt; a broadcast would carry all these copies through the driver, however large Spark's threshold."""
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("embedding"))
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), 3)
    assert got.count() == 12
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_top_k_equals_plain_ranking(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in np.round(r, 1)]) for i, r in enumerate(rng.standard_normal((230, 5)))]
    rows += [(300, None), (301, [None, 1.0, 1.0, 1.0, 1.0]), (302, [float("inf")] * 5), (303, [1.0, 2.0]), (None, [1.0] * 5), (7, rows[7][1]), (310, [3e5] * 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    usable = [(i, np.floor(1024 * np.array(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in usable if i % 10 == 0}.items():
        scored = sorted(((-int(v @ w), i) for i, w in usable if i != q and len(w) == len(v)))[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), 10)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.limit(0), df, 10).count() == 0


def test_best_keeps_smaller_ids_on_ties():
    scores = np.array([[5, 7, 7, 5, 5, 1], [1, 1, 1, 1, 1, 1]])
    s, i = topk.best(scores, np.arange(6), 3)
    assert sorted(zip((-s[0]).tolist(), i[0].tolist(), strict=True)) == [(-7, 1), (-7, 2), (-5, 0)] and i[1].tolist() == [0, 1, 2]


def test_near_copies_without_ids_or_under_one_id(spark):
    """Texts are found by id and hash: shared ids make no pairs of texts, so many take no longer than with ids of their own."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]

    def copies(n, i):
        rows = []
        for k in range(n):
            own = list(words)
            own[rng.randrange(400)] = f"x{k}"
            rows.append((i(k), " ".join(own)))
        return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    took = {}
    for name, i in (("warm", lambda k: k), ("own", lambda k: k), ("null", lambda k: None), ("shared", lambda k: 7 if k else 3)):
        began = time.time()
        rows = jaccard.link(copies(1500, i), 5, 8, 10).collect()
        took[name] = time.time() - began
        assert len(rows) == 1500 and {r["n_links"] for r in rows} == {1499}
        assert {r["component_id"] for r in rows} == {{"null": None, "shared": 3}.get(name, 0)}
    assert max(took["null"], took["shared"]) < 3 * took["own"] + 10, took


@pytest.mark.parametrize("most", [1 << 15, 1 << 29])
def test_a_filter_lets_all_its_hashes_through(spark, monkeypatch, most):
    monkeypatch.setattr(membership, "MAX_BITS", most)
    some = membership.may_hold(spark.range(0, 20_000).selectExpr("xxhash64(id)"))
    asked = spark.range(0, 60_000).withColumn("in", some(F.xxhash64("id")))
    got = {r["own"]: (r["yes"], r["n"]) for r in asked.groupBy((F.col("id") < 20_000).alias("own")).agg(F.count_if("in").alias("yes"), F.count("*").alias("n")).collect()}
    assert got[True] == (20_000, 20_000)
    assert got[False][0] < 0.03 * 40_000 or most < 1 << 20
    assert spark.range(5).where(membership.may_hold(spark.range(0).select("id"))(F.col("id") + 1)).count() == 0


def test_a_filter_that_lets_all_through_changes_no_link(spark, monkeypatch):
    monkeypatch.setattr(membership, "BITS_EACH", 0)
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    monkeypatch.setattr(jaccard, "PACK_BYTES", 2000)
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(_family(rng, [f"w{i}" for i in range(60)], 80, 7) + [f"own{i} text{i} here{i}" for i in range(40)])]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect())
    assert got == _plain_link(rows, 3, 80, 100)
