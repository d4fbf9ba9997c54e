"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one class with a count. In each of PASSES passes, a label's classes
are ordered by the concatenated signs of random projections of what they differ in from the
label's mean, and cut into blocks of BLOCK with WINDOW more that they share with the next. All
pairs of a block are compared by exact cosine; the verified pairs of all passes are joined into
groups. Then each group is compared completely, in tasks of two bounded chunks, so a group of any
size keeps all its links, and n_links is exact for it. A label of at most BLOCK classes is one
group from the start. What can be missed is a link between two groups that no pass brought
together; ``exact`` takes every label as one group, at a cost that grows with its square.

Orders are made by Spark's range partitioning with ties cut by the class, so no task sorts a
label. Cosines come in single precision first, and in double precision what lies closer to the
threshold than rounding reaches. No pair is ever a row: tasks return counts and forests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.llm import batches, scratch
from provena.llm.components import connected_components
from provena.llm.topk import valid

SIMILAR = 0.93
PASSES = 8
#: Classes of a block and of a chunk, and how many of the next block's a block sees too.
BLOCK = 4096
WINDOW = 1024
#: Signs of a key.
BITS = 62
#: Groups of more than MANY chunks get larger ones, up to CHUNK_BYTES of doubles.
MANY = 16
CHUNK_BYTES = 8 << 20
#: Rows and columns of a tile of cosines, and numbers that one step of the double precision check holds.
TILE = (256, 4096)
EXACT_NUMBERS = 1 << 20
SEED = 20240711


def linked(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, similar: float) -> np.ndarray:
    """Whether rows of x and y have a cosine of at least ``similar``; xs and ys are the same in single precision."""
    slack = (x.shape[1] + 8) * 2.0**-23  # more than the rounding of a single precision product of unit vectors
    cosine = xs @ ys.T
    out = cosine >= similar + slack
    i, j = np.nonzero((cosine >= similar - slack) & ~out)
    step = max(1, EXACT_NUMBERS // x.shape[1])
    for at in range(0, len(i), step):
        one, two = i[at : at + step], j[at : at + step]
        out[one, two] = np.einsum("ij,ij->i", x[one], y[two]) >= similar
    return out


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, each the smallest member of its set, after the sets of i and j are joined."""
    while True:
        one, two = label[i], label[j]
        apart = one != two
        if not apart.any():
            return label
        i, j, one, two = i[apart], j[apart], one[apart], two[apart]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(less := root[root], root):
            root = less
        label = root[label]


def unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of length one, of vectors of one dimension."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(x: np.ndarray, docs: np.ndarray, split: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row, as a sum of docs, and the least row that it is joined to: of the first ``split`` rows with the others, or of all pairs if split is 0."""
    xs = x.astype(np.float32)
    counts, label = np.zeros(len(x)), np.arange(len(x))
    ones, twos = np.arange(split or len(x)), np.arange(split, len(x))
    for r in range(0, len(ones), TILE[0]):
        for c in range(0 if split else r, len(twos), TILE[1]):
            i, j = ones[r : r + TILE[0]], twos[c : c + TILE[1]]
            some = linked(x[i], x[j], xs[i], xs[j], similar)
            if not split:
                some &= i[:, None] < j
            used = np.flatnonzero(some.any(axis=1))
            if len(used):
                some, i = some[used], i[used]
                weights = some.astype(np.float64)
                counts[i] += weights @ docs[j]
                counts[j] += docs[i] @ weights
                a, b = np.nonzero(some & (label[i][:, None] != label[j]))
                label = joined(label, i[a], j[b])
    return counts, label


FOUND = "a long, b long, links long"


def _found(uids: np.ndarray, counts: np.ndarray | None, label: np.ndarray) -> pa.RecordBatch:
    """Counts as rows (a, null, links), the forest as rows (a, b, null)."""
    tree = np.flatnonzero(label != np.arange(len(label)))
    some = np.flatnonzero(counts) if counts is not None else tree[:0]
    n = len(some) + len(tree)
    first = np.arange(n) < len(some)
    links = np.zeros(n, np.int64)
    if counts is not None:
        links[: len(some)] = counts[some].astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([uids[some], uids[tree]])), pa.array(np.concatenate([np.zeros(len(some), np.int64), uids[label[tree]]]), mask=first), pa.array(links, mask=~first)], ["a", "b", "links"]
    )


def in_blocks(similar: float) -> Callable:
    """Forests of the blocks of (pass_id, block, uid, embedding)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches.runs(parts, ["pass_id", "block"]):
            if len(t) > 1:
                yield _found(t.column("uid").to_numpy(), None, compare(unit(t.column("embedding")), np.ones(len(t)), 0, similar)[1])
        batches.trim()

    return run


def in_groups(similar: float) -> Callable:
    """Counts and forests of pairs of chunks of (group_id, low, high, chunk, uid, docs, embedding)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches.runs(parts, ["group_id", "low", "high"]):
            low, high, chunk = t.column("low")[0].as_py(), t.column("high")[0].as_py(), t.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            split = int((chunk == low).sum()) if low != high else 0
            if len(t) > 1 and (low == high or 0 < split < len(t)):
                t = t.take(pa.array(order))
                yield _found(t.column("uid").to_numpy(), *compare(unit(t.column("embedding")), t.column("docs").to_numpy().astype(np.float64), split, similar))
        batches.trim()

    return run


def _totals(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by group of one batch: (label_id, n, total)."""
    for batch in parts:
        ids = batch.column(0).to_numpy()
        names, back = np.unique(ids, return_inverse=True)
        for k, name in enumerate(names):
            x = unit(batch.column(1).take(pa.array(np.flatnonzero(back == k))))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.float64()))], ["label_id", "n", "total"])


def _keys(passes: int) -> Callable:
    """Keys of (label_id, uid, embedding, mean): a row (pass_id, key, uid) for each pass."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.int64(1) << np.arange(BITS, dtype=np.int64)[::-1]
        for batch in parts:
            ids, uids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            dims = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = pa.array(np.flatnonzero(dims == dim))
                mean = batch.column(3).take(own).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                sides = (unit(batch.column(2).take(own)) - mean) @ np.random.default_rng(SEED + int(dim)).standard_normal((int(dim), passes * BITS)) > 0
                keys = sides.reshape(len(own), passes, BITS) @ powers
                for k in range(passes):
                    # A pass of a label is known by a mix of both; two that met in one would only be compared together.
                    pass_id = (ids[own] * np.int64(0x5851F42D4C957F2D) + np.int64(k) * np.int64(0x14057B7EF767814F)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pass_id), pa.array(keys[:, k]), pa.array(uids[own])], ["pass_id", "key", "uid"])
        batches.trim()

    return run


def _numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pass_id, uid, part, nth) of a task's sorted rows: nth counts within the task's rows of a pass."""
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in parts:
        ids = batch.column(0).to_numpy()
        n = len(ids)
        if not n:
            continue
        new = np.concatenate(([ids[0] != last], ids[1:] != ids[:-1]))
        starts = np.where(new, np.arange(n), 0)
        before = np.where(np.maximum.accumulate(new), 0, seen)
        nth = np.arange(n) - np.maximum.accumulate(starts) + before
        last, seen = ids[-1], int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(n, part, np.int32)), pa.array(nth.astype(np.int64))], ["pass_id", "uid", "part", "nth"])


def _candidates(classes: DataFrame, similar: float, passes: int, block: int, window: int) -> DataFrame:
    """Edges (a, b) between classes (label_id, uid, embedding) that some pass found linked; their labels are larger than a block."""
    summed = classes.select("label_id", "embedding").mapInArrow(_totals, "label_id long, n long, total array<double>")
    cells = summed.select("label_id", "n", F.posexplode("total").alias("at", "v")).groupBy("label_id", "at").agg((F.sum("v") / F.sum("n")).alias("v"))
    means = cells.groupBy("label_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("mean")).withColumnRenamed("label_id", "l")
    keyed = classes.join(means, F.col("label_id") == F.col("l")).select("label_id", "uid", "embedding", "mean").mapInArrow(_keys(passes), "pass_id long, key long, uid long")
    keyed = scratch.materialize(keyed, "vector_keys")
    order = ["pass_id", "key", "uid"]
    ranked = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("pass_id", "uid")
    ranked = scratch.materialize(ranked.mapInArrow(_numbered, "pass_id long, uid long, part int, nth long"), "vector_ranks")
    scratch.drop(keyed)
    before = W.partitionBy("p").orderBy("q").rowsBetween(W.unboundedPreceding, -1)  # a row for each task that has rows of the pass
    starts = ranked.groupBy(F.col("pass_id").alias("p"), F.col("part").alias("q")).agg(F.count("*").alias("c")).select("p", "q", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    blocks = ranked.join(starts, (F.col("pass_id") == F.col("p")) & (F.col("part") == F.col("q"))).select("pass_id", F.col("uid").alias("u"), (F.col("start") + F.col("nth")).alias("rank"))
    first = F.expr(f"rank div {int(block)}")
    both = F.when((F.expr(f"rank % {int(block)}") < window) & (first > 0), F.array(first, first - 1)).otherwise(F.array(first))
    dealt = blocks.select("pass_id", "u", F.explode(both).alias("block")).join(classes, F.col("u") == F.col("uid")).select("pass_id", "block", "uid", "embedding")
    dealt = dealt.repartition("pass_id", "block").sortWithinPartitions("pass_id", "block")
    return dealt.mapInArrow(in_blocks(similar), FOUND).select("a", "b").distinct()


def near_duplicates(df: DataFrame, similar: float = SIMILAR, passes: int = PASSES, block: int = BLOCK, window: int = WINDOW, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Rows of equal, not null labels are linked when their cosine, in double precision, is at least
    ``similar``. Labels of up to ``block`` distinct vectors, and every group that the passes find
    in larger ones, are compared completely; with ``exact`` all labels are. Null or zero vectors,
    and those that hold null, NaN or infinite components, link with nothing; nor do vectors of
    different dimensions. Equal vectors are always linked. Rows that repeat an id are vectors of
    their own; null ids count as no smallest id. An empty table gives no rows.
    """
    batches.bound(df.sparkSession)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    usable = F.col("label").isNotNull() & valid(F.col("embedding")) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("uid", F.when(usable, F.xxhash64("label", "embedding")))
    classes = rows.where("uid is not null").groupBy("uid", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("docs"))
    classes = scratch.materialize(classes.withColumn("label_id", F.xxhash64("label", F.size("embedding"))).drop("label"), "vector_classes")
    of_label = classes.groupBy("label_id").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).select(F.col("label_id").alias("group_id"), "n", "dims")
    of_label = scratch.materialize(of_label, "vector_labels")
    whole = of_label if exact else of_label.where(F.col("n") <= block)
    members = classes.select("uid", "embedding", "docs", F.col("label_id").alias("g"))
    large = of_label.where(F.col("n") > block).select(F.col("group_id").alias("l"))
    grouped, sizes = members, whole
    if not exact and large.limit(1).count():
        sub = classes.join(large, F.col("label_id") == F.col("l"), "left_semi").select("label_id", "uid", "embedding")
        parts = connected_components(_candidates(sub, similar, passes, block, window)).select(F.col("id").alias("i"), F.xxhash64(F.lit("group"), "component").alias("c"))
        parts = scratch.materialize(parts, "vector_groups")
        found = members.drop("g").join(parts, F.col("uid") == F.col("i")).select("uid", "embedding", "docs", F.col("c").alias("g"))
        grouped = members.join(whole.select(F.col("group_id").alias("w")), F.col("g") == F.col("w"), "left_semi").unionByName(found)
        sizes = whole.unionByName(found.groupBy(F.col("g").alias("group_id")).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")))
    size = F.expr(f"greatest(1, least(greatest({int(block)}, n div {MANY}), {CHUNK_BYTES} div (8 * dims)))")
    sizes = sizes.where("n > 1").select("group_id", F.ceil(F.col("n") / size).alias("chunks"))
    dealt = grouped.join(sizes, F.col("g") == F.col("group_id")).withColumn("chunk", F.pmod("uid", "chunks"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.struct(F.least(c, "chunk").alias("low"), F.greatest(c, "chunk").alias("high")))
    dealt = dealt.withColumn("pair", F.explode(others)).select("group_id", "pair.low", "pair.high", "chunk", "uid", "docs", "embedding")
    dealt = dealt.repartition("group_id", "low", "high").sortWithinPartitions("group_id", "low", "high")
    found = scratch.materialize(dealt.mapInArrow(in_groups(similar), FOUND), "vector_links")
    parts = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    names = classes.select("uid", "rep", "docs").join(parts, F.col("uid") == F.col("id"), "left").join(links, F.col("uid") == F.col("a"), "left")
    names = names.select("uid", "rep", "docs", F.coalesce("component", "uid").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    least = names.groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "c")
    names = names.join(least, F.col("component") == F.col("c")).select(F.col("uid").alias("u"), F.col("least").alias("component_id"), (F.col("links") + F.col("docs") - 1).alias("n"))
    some = rows.where("uid is not null").join(names, F.col("uid") == F.col("u")).select("vec_id", F.col("n").cast("long").alias("n_links"), "component_id")
    none = rows.where("uid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings of a label, at cosine 0.93."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0),
n as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as d from v),
l as (
  select a.vec_id as x, b.vec_id as y from n a join n b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.d * b.d) >= 0.93),
s as (select x, y from l union select y, x from l),
r as (select vec_id as x, vec_id as y from embeddings union select r.x, s.y from r join s on r.y = s.x),
c as (select x, min(y) as component_id from r group by x),
k as (select x, count(*)::bigint as n_links from s group by x)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join c on c.x = vec_id left join k on k.x = vec_id
"""

QUERIES = {"op9_embedding_near_dedup": op9_embedding_near_dedup}
ORACLE_SQL = {"op9_embedding_near_dedup": _SQL}
