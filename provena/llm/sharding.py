"""K-d tree sharding with distributed weighted medians; DataFrame functions only.

A node of the tree holds some of the shards. It is split along its widest metadata dimension
at the weighted quantile that divides its bytes as its shards divide, until a leaf is one
shard. All nodes of a level are split together: each pass is one aggregation of
(node, bin) -> bytes, so at most ``2 * n_shards * BINS`` rows reach the driver, whatever the
table's size. Ties in a dimension are cut along a hash of the row's identity, so one source
that holds a third of all rows is divided like any other; rows of one identity are told apart by
where they lie in the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.llm import scratch

BINS = 256
#: A cut is good when it is within this part of a leaf's bytes of its goal.
TOLERANCE = 0.0005
MAX_SHARDS = 65_536
#: Rows of one numbering task, about.
SLOT_ROWS = 1_000_000


def text_order(c: Column) -> Column:
    """A double that sorts as the string's first six bytes do; null sorts first."""
    head = F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(-1.0))


def number(c: Column) -> Column:
    """A double for any numeric column; null and NaN sort first."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(-1.0)).otherwise(d)


def _tie(identity: list[Column]) -> Column:
    """A double in [0, 1): 33 bits of a hash of the row's identity, then 20 of one of its place in the table.

    Rows of different identities keep their order however the table is read; equal rows can be cut apart.
    """
    own = F.shiftrightunsigned(F.xxhash64(*identity), 31)
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 44)
    return F.shiftleft(own, 20).bitwiseOR(place).cast("double") / F.lit(float(2**53))


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, F.least(F.lit(BINS - 1), F.floor((x - lo) / (hi - lo) * BINS).cast("int"))).otherwise(0)


class Tree:
    """Levels of cuts, held on the driver: at most ``2 * n_shards`` numbers of each kind."""

    def __init__(self, n_shards: int, dims: list[str]):
        if not 1 <= n_shards <= MAX_SHARDS:
            raise ValueError(f"n_shards must be from 1 to {MAX_SHARDS}")
        self.dims, self.depth = dims, 0
        self.nodes = {0: (0, n_shards)}  # node: its first shard, their number

    def pick(self, values: dict[int, float | int], other: float | int, node: Column, level: int) -> Column:
        kind = float if isinstance(other, float) else int
        return F.element_at(F.lit([kind(values.get(i, other)) for i in range(2**level)]), node + 1)

    def value(self, dim: dict[int, int], node: Column, level: int) -> Column:
        return F.element_at(F.array(*[F.col(d) for d in self.dims]), self.pick(dim, 0, node, level) + 1)

    def step(self, base: DataFrame, cuts: tuple[dict, dict, dict], level: int) -> DataFrame:
        """``base`` with each row's node one level down, written anew: no later pass repeats the comparisons."""
        dim, cut, tie = cuts
        node = F.col("__node")
        v, at = self.value(dim, node, level), self.pick(cut, math.inf, node, level)
        left = (v < at) | ((v == at) & (F.col("__tie") <= self.pick(tie, 2.0, node, level)))
        out = scratch.materialize(base.withColumn("__node", (node * 2 + F.when(left, 0).otherwise(1)).cast("int")), "kd_level")
        scratch.drop(base)
        return out

    def grow(self, placed: DataFrame, widths: dict[str, float]) -> DataFrame:
        """Split every node that holds more than one shard."""
        level = self.depth
        stats = placed.groupBy("__node").agg(
            F.sum("__size").alias("w"), *[f(d).alias(f"{n}_{d}") for d in self.dims for n, f in (("lo", F.min), ("hi", F.max))]
        )
        state = {}
        dim: dict[int, int] = {}
        for r in stats.collect():
            first, n = self.nodes[r["__node"]]
            if n > 1:
                spread = [(r[f"hi_{d}"] - r[f"lo_{d}"]) / (widths[d] or 1.0) for d in self.dims]
                k = max(range(len(spread)), key=lambda i: (spread[i], -i))
                d = self.dims[k]
                dim[r["__node"]] = k
                leaf = r["w"] / n
                state[r["__node"]] = {"goal": leaf * (n // 2), "slack": leaf * TOLERANCE, "before": 0.0, "mode": 0, "at": 0.0, "lo": r[f"lo_{d}"], "hi": r[f"hi_{d}"]}
        cut: dict[int, float] = {}
        tie: dict[int, float] = {}
        while state:
            node = F.col("__node")
            get = lambda k, other: self.pick({i: s[k] for i, s in state.items()}, other, node, level)  # noqa: B023, E731
            v = self.value(dim, node, level)
            x = F.when(get("mode", -1) == 0, v).when((get("mode", -1) == 1) & (v == get("at", 0.0)), F.col("__tie"))
            rows = (
                placed.select("__node", "__size", x.alias("x"), get("lo", 1.0).alias("lo"), get("hi", 0.0).alias("hi"))
                .where("x >= lo and x <= hi")
                .groupBy("__node", _bin(F.col("x"), F.col("lo"), F.col("hi")).alias("b"))
                .agg(F.sum("__size").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"))
                .collect()
            )
            by_node: dict[int, list] = {}
            for r in sorted(rows, key=lambda r: (r["__node"], r["b"])):
                by_node.setdefault(r["__node"], []).append(r)
            for i, bins in by_node.items():
                s, cum = state[i], state[i]["before"]
                for r in bins:  # noqa: B007
                    if cum + r["w"] >= s["goal"]:
                        break
                    cum += r["w"]
                under, over = s["goal"] - cum, cum + r["w"] - s["goal"]
                done = min(under, over) <= s["slack"] or (r["lo"] == r["hi"] and s["mode"] == 1)
                if not done and r["lo"] == r["hi"]:
                    s |= {"before": cum, "mode": 1, "at": r["lo"], "lo": 0.0, "hi": 1.0}
                elif not done:
                    s |= {"before": cum, "lo": r["lo"], "hi": r["hi"]}
                else:
                    whole = over < under  # the bin goes left with what is before it
                    if s["mode"] == 0:
                        cut[i], tie[i] = (r["hi"], 2.0) if whole else (r["lo"], -1.0)
                    else:
                        cut[i], tie[i] = s["at"], r["hi"] if whole else math.nextafter(r["lo"], -1.0)
                    del state[i]
        self.depth += 1
        nodes = {}
        for i, (first, n) in self.nodes.items():
            nodes[2 * i] = (first, n // 2 if n > 1 else 1)
            if n > 1:
                nodes[2 * i + 1] = (first + n // 2, n - n // 2)
        self.nodes = nodes
        return self.step(placed, (dim, cut, tie), level)


def kd_shards(df: DataFrame, dims: dict[str, Column], size: Column, identity: list[Column], n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``df`` with columns ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in a shard).

    Give ``n_shards``, or ``target_bytes`` of a leaf. Every row goes to one shard: null values
    of a dimension sort before all others, repeated rows are rows of their own and are cut apart
    like others, an empty table gives no rows; columns named shard and slot are replaced. ``df`` is
    read once: its columns, sizes and dimensions are written to the shared folder, so pass narrow
    columns, not texts.
    """
    names = [f"__d{i}" for i in range(len(dims))]
    df = df.drop("shard", "slot")
    base = df.select(
        *[F.col(f"`{c}`") for c in df.columns],
        size.cast("long").alias("__size"),
        _tie(identity).alias("__tie"),
        *[c.alias(n) for n, c in zip(names, dims.values(), strict=True)],
    )
    base = scratch.materialize(base.withColumn("__node", F.lit(0)), "kd_base")
    whole = base.agg(F.count("*").alias("n"), F.sum("__size").alias("w"), *[(F.max(n) - F.min(n)).alias(n) for n in names]).first()
    if n_shards is None:
        n_shards = max(1, math.ceil((whole["w"] or 0) / target_bytes))
    tree = Tree(n_shards, names)
    while whole["n"] and any(n > 1 for _, n in tree.nodes.values()):
        base = tree.grow(base, {n: whole[n] for n in names})
    leaf = F.element_at(F.lit([tree.nodes.get(i, (0, 0))[0] for i in range(2**tree.depth)]), F.col("__node") + 1)
    placed = base.withColumn("shard", leaf.cast("int")).select(*[F.col(f"`{c}`") for c in df.columns], "shard", "__tie")
    # Numbers within a shard: hash buckets are counted, then each bucket is numbered by a task of its own.
    buckets = max(1, math.ceil(whole["n"] / n_shards / SLOT_ROWS))
    placed = placed.withColumn("__b", F.floor(F.col("__tie") * buckets).cast("int"))
    before = W.partitionBy("shard").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "__b").agg(F.count("*").alias("__c")).select("shard", "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(W.partitionBy("shard", "__b").orderBy("__tie"))
    return placed.withColumn("__r", inside).join(starts, ["shard", "__b"]).withColumn("slot", F.col("__start") + F.col("__r") - 1).drop("__b", "__r", "__start", "__tie")


def op1_kd_tree_shards(spark: SparkSession, sf_dir: str, n_shards: int = 40) -> DataFrame:
    """All documents in shards of near equal bytes, by source, language, length and id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
        "source",
        "lang",
    )
    dims = {"source": text_order(F.col("source")), "lang": text_order(F.col("lang")), "length": F.log(F.col("size")), "doc_id": number(F.col("doc_id"))}
    out = kd_shards(narrow, dims, F.col("size"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_kd_tree_shards": op1_kd_tree_shards}
ORACLE_SQL: dict[str, str] = {}
