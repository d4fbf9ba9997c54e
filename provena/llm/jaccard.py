"""Exact Jaccard join of shingle sets, by relations among sets.

Equal sets are one set with a count of its documents. The others meet over a distributed
inverted index of prefixes: the rarest hashes of each set, as many as a partner must share one
of. Each list is ordered by size and entries are skipped in blocks whose position shows that no
partner is left; what stays together in a list is a candidate class. Entries that must end in one
class are made one where they arise, so a token that very many sets share makes no long list.
Classes are cut into chunks of about CHUNK sets or CHUNK_BYTES of hashes, ordered by size, from
counts of their sizes; each pair of chunks that can hold a link is a task of bounded size. There a set's overlaps with the whole chunk are derived from those of its
most similar predecessor, through the index lists of the few hashes in which the two differ.
No pair of sets is ever a row: tasks return counts of links and the edges of a forest.
Chunks travel as texts, packed by the chunk, since near copies pack to a fraction of their hashes;
the task that compares them makes the sets again.

The order "rarest first" comes from a table of SLOTS counters over hashed shingles: of fixed
size however large the corpus, and any table gives the same result, only faster or slower.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.llm import batches, scratch
from provena.llm.components import connected_components
from provena.llm.membership import may_hold
from provena.llm.shingles import mix, set_id, shingle_set, word_hashes

SLOTS = 1 << 20
SEGMENTS = 64
CHUNK = 4096
CHUNK_BYTES = 16 << 20
#: Bytes of hashes that one task compares, about; more tasks are made for more.
TASK_BYTES = 16 << 20
#: Counter tables of tasks that are added up in one step.
TABLES = 256
#: Bytes of texts that a task holds to pack those of one chunk together.
PACK_BYTES = 16 << 20
#: Ids that one_of_each() broadcasts to take rows out, at most (about 120 MB: 6 MB were measured for 50,000); more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000
#: Prefix entries of one task, about, and of one flush of a task that makes them.
LIST_ENTRIES = 400_000
FLUSH_ENTRIES = 1 << 18

FACTS = "kind int, doc_id long, n long, uid long, text_hash long, segment int, counts binary"
ENTRIES = "kind int, part int, tokens binary, uids binary, sizes binary, reach binary"
PACKS = "cluster long, c1 int, c2 int, side int, uids binary, docs binary, lengths binary, texts binary"
FOUND = "a long, b long, links long"


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    """UTF-8 of the second column; null is empty."""
    return [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    return _made(_texts(batch), width)


def _made(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    at = 0
    while at < len(texts):  # a few at a time: their words' hashes are held together
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= 2 << 20):
            size += len(texts[end])
            end += 1
        for words in word_hashes(texts[at:end]):
            yield shingle_set(words, width)
        at = end


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64) & (SLOTS - 1)


def first_pass(width: int):
    """Sizes and names of sets; at a task's end the counters of its shingles, with the task's number as n."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(SLOTS, np.int64)
        some = False
        names = ["kind", "doc_id", "n", "uid", "text_hash", "segment", "counts"]
        none = lambda n, kind: pa.nulls(n, kind)
        for batch in parts:
            ns, ids, held, size = [], [], [], 0
            for s in _sets(batch, width):
                ns.append(len(s))
                ids.append(set_id(s))
                held.append(_slot(s))
                size += len(s)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = [], 0
            if held:
                counts += np.bincount(np.concatenate(held), minlength=SLOTS)
            some = some or bool(ns)
            n = len(ns)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(ids, pa.int64()), batch.column(2), none(n, pa.int32()), none(n, pa.binary())], names)
        if some:
            cut = [np.minimum(c, 2**32 - 1).astype("<u4").tobytes() for c in np.split(counts, SEGMENTS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(SEGMENTS, np.int32)), none(SEGMENTS, pa.int64()), pa.array(np.full(SEGMENTS, TaskContext.get().partitionId(), np.int64)), none(SEGMENTS, pa.int64()), none(SEGMENTS, pa.int64()), pa.array(np.arange(SEGMENTS, dtype=np.int32)), pa.array(cut, pa.binary())], names)
        batches.trim()

    return run


def order_table(facts: DataFrame) -> np.ndarray:
    """The SLOTS counters, cut to 16 bits. Tasks' tables are added up in a tree, TABLES at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // SEGMENTS, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<u4")
        cut = np.minimum(total, 2**32 - 1).astype("<u4").tobytes()
        return pa.table({"segment": table.column("segment").slice(0, 1), "task": pa.array([table.column("task")[0].as_py()], pa.int64()), "counts": pa.array([cut], pa.binary())})

    summed = facts.where("kind = 1").select("segment", F.col("n").alias("task"), "counts")
    most = summed.agg(F.max("task")).first()[0] or 0
    while most > 0:
        summed = summed.withColumn("task", F.expr(f"task div {TABLES}")).groupBy("segment", "task").applyInArrow(add, "segment int, task long, counts binary")
        most //= TABLES
    rows = sorted((r["segment"], r["counts"]) for r in summed.collect())  # SEGMENTS rows of fixed size
    counts = np.concatenate([np.frombuffer(c, "<u4") for _, c in rows]) if rows else np.zeros(SLOTS, np.uint32)
    # Counts matter relative to each other; 16 bits keep their order to within a hundredth.
    return np.minimum(np.log1p(counts.astype(np.float64)) * 2900, 65535).astype(np.uint16)


def _lone(tokens: np.ndarray, uids: np.ndarray, sizes: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which entries stay when those of one token and size that reach each other are made one, and edges that join their sets."""
    by = np.lexsort((-reach, sizes, tokens))
    new = np.ones(len(by), bool)
    new[1:] = (tokens[by[1:]] != tokens[by[:-1]]) | (sizes[by[1:]] != sizes[by[:-1]])
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    same = ~new & (reach[by] >= sizes[by])  # the head reaches as far at least
    keep = np.ones(len(by), bool)
    keep[by[same]] = False
    pairs = np.unique(np.stack([uids[by[same]], uids[head[same]]]), axis=1)
    return keep, pairs[0], pairs[1]


def _six(tokens: np.ndarray) -> bytes:
    """Six bytes of each hash: hashes that share them only add candidates."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def second_pass(width: int, num: int, den: int, order, parts_n: int):
    """Prefix entries of the sets, packed by the part of the index that they belong to (kind 0), and edges (kind 1: ends in tokens and uids).

    A partner of size m needs num * (n + m) <= (num + den) * overlap, and a pair's overlap is at
    most what either has from the first shared place on. So ``reach`` is the largest partner an
    entry can have at its place; entries whose reach ends before their smallest partner go.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = order.value
        held: list[tuple] = []
        size = 0
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, uids, sizes, places = (np.concatenate(x) for x in zip(*held, strict=True))
            reach = (sizes - places) * (num + den) // num - sizes
            some = reach * den >= sizes * num
            tokens, uids, sizes, reach = tokens[some] >> np.uint64(16) << np.uint64(16), uids[some], sizes[some], reach[some]
            keep, a, b = _lone(tokens, uids, sizes, reach)
            tokens, uids, sizes, reach = tokens[keep], uids[keep], sizes[keep], reach[keep]  # set by set, which packs well
            for kind, x, y, more in ((0, tokens, uids, (sizes, reach)), (1, a.view(np.uint64), b, (a[:0], a[:0]))):
                if not len(x):
                    continue
                part = (mix(x) % np.uint64(parts_n)).astype(np.int32)
                by = np.argsort(part, kind="stable")
                own, at = np.unique(part[by], return_index=True)
                cut = lambda v, t: pa.array([c.astype(t).tobytes() for c in np.split(v[by], at[1:])] if len(v) else [b""] * len(own), pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own), cut(x, "<u8") if kind else pa.array([_six(c) for c in np.split(x[by], at[1:])], pa.binary()), cut(y, "<i8"), *[cut(v, "<i4") for v in more]], ["kind", "part", "tokens", "uids", "sizes", "reach"])

        for batch in parts:
            for s in _sets(batch, width):
                n = len(s)
                uid = set_id(s)
                if not n or uid in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(uid)
                k = n - -(-num * n // den) + 1
                rank = table[_slot(s)]
                if k < n:
                    few = np.flatnonzero(rank <= np.partition(rank, k - 1)[k - 1])
                else:
                    few = np.arange(n)
                first = few[np.lexsort((s[few], rank[few]))][:k]
                held.append((s[first], np.full(k, uid, np.int64), np.full(k, n, np.int64), np.arange(k)))
                size += k
                if size >= FLUSH_ENTRIES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        batches.trim()

    return run


def candidate_classes():
    """Edges that join the sets of each index list that may be linked there.

    Over a list ordered by size, a run ends where the next size is beyond the reach of all before
    it: the block behind it is skipped for them.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in parts:
            for r in batch.to_pylist():
                uids = np.frombuffer(r["uids"], "<i8")
                if r["kind"]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["tokens"], "<i8")), pa.array(uids)], ["a", "b"])
                else:
                    held.append((_from_six(r["tokens"]), uids, np.frombuffer(r["sizes"], "<i4"), np.frombuffer(r["reach"], "<i4")))
        if not held:
            return
        tokens, uids, sizes, reach = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        by = np.lexsort((uids, sizes, tokens))
        tokens, uids, sizes, reach = tokens[by], uids[by], sizes[by].astype(np.int64), reach[by].astype(np.int64)
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (uids[1:] != uids[:-1])  # copies came from several tasks
        tokens, uids, sizes, reach = tokens[new], uids[new], sizes[new], reach[new]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        lengths = np.diff(np.concatenate((starts, [len(tokens)])))
        a, b = [], []
        for s, n in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist(), strict=True):
            far = np.maximum.accumulate(reach[s : s + n])
            breaks = np.flatnonzero(sizes[s + 1 : s + n] > far[:-1]) + 1
            heads = np.zeros(n, np.int64)
            heads[breaks] = breaks
            heads = np.maximum.accumulate(heads)
            own = np.flatnonzero(heads != np.arange(n))
            a.append(uids[s + own])
            b.append(uids[s + heads[own]])
        if a:
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
        batches.trim()

    return run


def overlaps(sets: list[np.ndarray], probes: list[np.ndarray]) -> np.ndarray:
    """Overlap of each probe (row) with each set (column).

    A row is derived from that of the earlier probe with the largest overlap, if the two differ
    in fewer hashes than the probe has: lists of hashes that only one of them has are added or
    taken away. Else it is counted afresh.
    """
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    names, at = np.unique(tokens, return_index=True)
    at = np.append(at, len(tokens))

    def row(some: np.ndarray) -> np.ndarray:
        i = np.searchsorted(names, some)
        i = np.minimum(i, len(names) - 1)
        i = i[names[i] == some]
        if not len(i):
            return np.zeros(len(sets), np.int64)
        n = at[i + 1] - at[i]
        where = np.repeat(at[i] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(owner[where], minlength=len(sets))

    out = np.zeros((len(probes), len(sets)), np.int32)
    same = sets is probes
    last = None
    for k, p in enumerate(probes):
        near = None
        if same and k:
            near = int(np.argmax(out[:k, k]))  # computed answers already hold this probe's overlap with each
        elif last is not None:
            near = last
        if near is not None:
            q = probes[near]
            more, less = np.setdiff1d(p, q, assume_unique=True), np.setdiff1d(q, p, assume_unique=True)
            if len(more) + len(less) < len(p) // 2:
                out[k] = out[near] + row(more) - row(less)
            else:
                out[k] = row(p)
        else:
            out[k] = row(p)
        last = k
    return out


def solver(width: int, num: int, den: int):
    """Counts of links and a forest of each (cluster, c1, c2) run of packed rows."""

    def solve(c1: int, c2: int, sides: list[dict[int, tuple[np.ndarray, int]]]) -> list[tuple]:
        left = sides[0]
        right = left if c1 == c2 else sides[1]
        if not left or not right or (left is right and len(left) == 1):
            return []
        sets = [s for s, _ in left.values()]
        probes = sets if left is right else [s for s, _ in right.values()]
        o = overlaps(sets, probes)
        n, m = np.array([len(s) for s in sets]), np.array([len(s) for s in probes])
        linked = np.empty(o.shape, bool)
        for r in range(0, len(m), 256):
            part = o[r : r + 256].astype(np.int64)
            linked[r : r + 256] = den * part >= num * (m[r : r + 256, None] + n - part)
        if left is right:
            np.fill_diagonal(linked, False)
        uids, other = np.array(list(left)), np.array(list(right))
        docs, of = np.array([d for _, d in left.values()]), np.array([d for _, d in right.values()])
        out = [(u, None, c) for u, c in zip(other.tolist(), (linked @ docs).tolist(), strict=True) if c]
        if left is not right:
            out += [(u, None, c) for u, c in zip(uids.tolist(), (of @ linked).tolist(), strict=True) if c]
        # A forest: each label falls to the least among its neighbours until none does.
        i, j = np.nonzero(linked)
        if len(i):
            nodes = np.unique(np.concatenate([other[i], uids[j]]))
            a, b = np.searchsorted(nodes, other[i]), np.searchsorted(nodes, uids[j])
            label = np.arange(len(nodes))
            while True:
                new = label.copy()
                np.minimum.at(new, a, label[b])
                np.minimum.at(new, b, label[a])
                new = new[new]
                if np.array_equal(new, label):
                    break
                label = new
            out += [(int(x), int(nodes[r]), None) for x, r in zip(nodes, label, strict=True) if nodes[r] != x]
        return out

    def unpack(r: dict, into: dict[int, tuple[np.ndarray, int]]) -> None:
        """The row's sets by uid: a text whose set has another name only shares an id and a hash with the one that was asked for."""
        lengths = np.frombuffer(r["lengths"], "<i8")
        data, at = zstandard.decompress(r["texts"], max_output_size=int(lengths.sum())), 0
        texts = []
        for n in lengths.tolist():
            texts.append(data[at : at + n])
            at += n
        asked = zip(np.frombuffer(r["uids"], "<i8").tolist(), np.frombuffer(r["docs"], "<i8").tolist(), _made(texts, width), strict=True)
        for uid, docs, s in asked:
            if uid not in into and set_id(s) == uid:
                into[uid] = (s, docs)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, out = None, [{}, {}], []

        def made() -> pa.RecordBatch:
            a, b, c = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["a", "b", "links"])

        for batch in parts:
            for r in batch.to_pylist():
                if (r["cluster"], r["c1"], r["c2"]) != key:
                    if key:
                        out += solve(*key[1:], sides)
                    key, sides = (r["cluster"], r["c1"], r["c2"]), [{}, {}]
                    if len(out) > 50_000:
                        yield made()
                        out = []
                unpack(r, sides[r["side"]])
        if key:
            out += solve(*key[1:], sides)
        if out:
            yield made()
        batches.trim()

    return run


def packer():
    """Texts of one chunk that a task has, packed together and once for each task that compares the chunk."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cluster", "c1", "c2", "side", "uids", "docs", "lengths", "texts"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        held: dict[tuple[int, int], tuple[list, dict[int, tuple[int, bytes]]]] = {}
        size = 0
        press = zstandard.ZstdCompressor(level=3)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            rows, sent = [], 0
            for (cluster, chunk), (tasks, own) in held.items():
                longs = lambda xs: np.array(xs, "<i8").tobytes()
                data = (longs(list(own)), longs([d for d, _ in own.values()]), longs([len(t) for _, t in own.values()]), press.compress(b"".join(t for _, t in own.values())))
                for t in tasks:
                    rows.append((cluster, t["c1"], t["c2"], int(t["c1"] != chunk), *data))
                    sent += sum(map(len, data))
                    if sent > batches.BATCH_BYTES:
                        yield batch_of(rows)
                        rows, sent = [], 0
            if rows:
                yield batch_of(rows)
            held.clear()

        for batch in parts:
            for r, text in zip(batch.drop_columns(["text"]).to_pylist(), _texts(batch), strict=True):
                own = held.setdefault((r["cluster"], r["chunk"]), (r["tasks"], {}))[1]
                if r["uid"] not in own:
                    own[r["uid"]] = (r["docs"], text)
                    size += len(text) + 64
                if size > PACK_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()
        batches.trim()

    return run


def link(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of (doc_id, text).

    Rows whose sets have den * |intersection| >= num * |union| are linked; component_id is the
    smallest doc_id reachable by links, n_links counts the other rows linked directly. Null and
    empty texts have no shingle, no link and their own id; fewer words than ``width`` make one
    shingle. Rows that repeat an id are rows of their own; a null id takes part and counts as no
    smallest id, so a component of null ids only has a null component_id. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    batches.bound(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    facts = scratch.materialize(hashed.mapInArrow(first_pass(width), FACTS), "set_facts")
    ids = facts.where("kind = 0").select("doc_id", "n", "uid", "text_hash")
    order = spark.sparkContext.broadcast(order_table(facts))
    total = ids.agg(F.sum("n")).first()[0] or 0
    parts_n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) * (den - num) // den // LIST_ENTRIES))
    entries = docs.mapInArrow(second_pass(width, num, den, order, parts_n), ENTRIES)
    edges = entries.repartition(parts_n, "part").mapInArrow(candidate_classes(), "a long, b long")
    clusters = connected_components(edges)
    # a set's text is found by the id and the hash of one of its rows: null ids, and ids of many texts, are told apart
    one_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")
    copies = ids.where("n > 0").groupBy("uid", "n").agg(one_row, F.count("*").alias("docs"))
    copies = copies.select("uid", "n", F.col("row.doc_id").alias("rep"), F.col("row.text_hash").alias("rep_hash"), "docs")
    members = clusters.join(copies, clusters["id"] == copies["uid"]).select(F.col("component").alias("cluster"), "uid", "n", "rep", "rep_hash", "docs")
    # A set's place in its cluster's order by size: what smaller sets weigh, and its share by hash of what those of its size weigh.
    heavy = F.greatest(F.lit(1 / CHUNK), 8 * F.col("n") / F.lit(CHUNK_BYTES))
    before = W.partitionBy("h").orderBy("m").rowsBetween(W.unboundedPreceding, -1)  # a row for each size in a cluster
    counted = members.groupBy(F.col("cluster").alias("h"), F.col("n").alias("m")).agg(F.count("*").alias("k"), (F.count("*") * heavy).alias("w"))
    counted = counted.select("h", "m", "k", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("start"))
    members = members.join(counted, (F.col("cluster") == F.col("h")) & (F.col("n") == F.col("m")))
    members = members.withColumn("chunk", (F.col("start") + F.pmod(F.xxhash64("uid"), "k") * heavy).cast("int")).drop("h", "m", "k", "start")
    members = scratch.materialize(members, "set_members")
    sizes = members.groupBy("cluster", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("sets"), F.sum(8 * F.col("n")).alias("bytes"))
    sizes = scratch.materialize(sizes, "set_chunks")
    one, two = sizes.select("cluster", F.col("chunk").alias("c1"), F.col("hi").alias("hi1")), sizes.select(F.col("cluster").alias("k"), F.col("chunk").alias("c2"), F.col("lo").alias("lo2"))
    tasks = one.join(two, F.col("cluster") == F.col("k")).where((F.col("c1") <= F.col("c2")) & (F.col("lo2") * num <= F.col("hi1") * den))
    tasks = tasks.select(F.col("cluster").alias("k"), F.struct("c1", "c2").alias("t"), F.explode(F.array_distinct(F.array("c1", "c2"))).alias("c")).groupBy("k", "c").agg(F.collect_list("t").alias("tasks"))
    tasks = scratch.materialize(tasks, "set_tasks")
    volume = tasks.join(sizes, (F.col("k") == sizes["cluster"]) & (F.col("c") == sizes["chunk"])).agg(F.sum(F.col("bytes") * F.size("tasks"))).first()[0] or 0
    dealt_n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(volume) // TASK_BYTES))
    wanted = members.join(tasks, (members["cluster"] == F.col("k")) & (members["chunk"] == F.col("c"))).select("cluster", "chunk", "uid", "docs", "tasks", "rep", "rep_hash")
    some = may_hold(members.select(F.xxhash64("rep", "rep_hash")))  # few texts but candidates' are shuffled
    hashed = hashed.where(some(F.xxhash64("doc_id", "text_hash")))
    texts = hashed.join(wanted, hashed["text_hash"].eqNullSafe(wanted["rep_hash"]) & hashed["doc_id"].eqNullSafe(wanted["rep"])).select("doc_id", "text", "cluster", "chunk", "uid", "docs", "tasks")
    dealt = texts.mapInArrow(packer(), PACKS).repartition(dealt_n, "cluster", "c1", "c2").sortWithinPartitions("cluster", "c1", "c2")
    found = scratch.materialize(dealt.mapInArrow(solver(width, num, den), FOUND), "set_links")
    parts = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("l_uid"), "links")
    names = copies.join(parts, copies["uid"] == parts["id"], "left").join(links, copies["uid"] == F.col("l_uid"), "left")
    names = names.select("uid", "rep", "docs", F.coalesce("component", "uid").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    least = names.groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "c")
    names = names.join(least, F.col("component") == F.col("c")).select(F.col("uid").alias("u"), F.col("least").alias("component_id"), (F.col("links") + F.col("docs") - 1).alias("n_links"))
    some = ids.where("n > 0").join(names, F.col("uid") == F.col("u")).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    none = ids.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if they are no more than BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each component of near copies: the one with the smallest doc_id.

    Rows that repeat an id stand or fall together, but of equal texts with one id only one stays.
    Only the ids that go are joined to the texts, not those that stay.
    """
    found = link(docs.select("doc_id", "text"), width, num, den)
    by_id = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first"), F.count("*").alias("rows"))
    by_id = scratch.materialize(by_id, "kept_ids")
    gone = _few(by_id.where("not first").select(F.col("doc_id").alias("gone_id")))
    stay = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
    again = _few(by_id.where("first and rows > 1").select(F.col("doc_id").alias("again_id")))
    single = stay.join(again, stay["doc_id"].eqNullSafe(again["again_id"]), "left_anti")
    return single.unionByName(stay.join(again, stay["doc_id"].eqNullSafe(again["again_id"]), "left_semi").dropDuplicates(["doc_id", "text"]))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of three-word shingles are at least 0.9 alike."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 90, 100)


_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select doc_id, list_distinct([w[i:i + 2] for i in range(1, greatest(2, len(w) - 1))]) as s from w where len(w) > 0),
t as (select doc_id, len(s) as n, hash(unnest(s)) as h from s),
n as (select doc_id, len(s)::bigint as n from s),
p as (
  select a.doc_id as x, b.doc_id as y, count(*) as o
  from t a join t b on a.h = b.h and a.doc_id < b.doc_id and a.n * 100 >= b.n * 90 and b.n * 100 >= a.n * 90 group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 90 * (a.n + b.n - o)),
e as (select x, y from l union select y, x from l),
r as (select doc_id as x, doc_id as y from documents union select r.x, e.y from r join e on r.y = e.x),
c as (select x, min(y) as component_id from r group by x),
k as (select x, count(*)::bigint as n_links from e group by x)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, coalesce(n_links, 0)::bigint as n_links
from documents left join n using (doc_id) join c on c.x = doc_id left join k on k.x = doc_id
"""

QUERIES = {"op4_ngram_jaccard": op4_ngram_jaccard}
ORACLE_SQL = {"op4_ngram_jaccard": _SQL}
