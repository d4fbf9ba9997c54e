"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Each document draws an exponential key, -ln(u) / quality weight, with u from a hash of its id,
so reruns agree. A source that needs more than all its words first gives whole epochs; the
fraction left is filled by its documents in order of key, until their running sum of sizes
meets the budget. Keys are cut into BUCKETS monotone buckets. Sums of buckets show which one
holds the end of the budget; only that one is sorted. Thus no task sorts a whole source, even
one that holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.llm import scratch

BUCKETS = 4096
#: Tables of up to so many sources are broadcast (about 100 bytes a source); beyond that the join shuffles.
BROADCAST_SOURCES = 50_000
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Sampling weight of a document by its quality label; UNLABELLED has those without one.
QUALITY = {1: 2.0, 0: 0.5}
UNLABELLED = 1.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponential_key(identity: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the first 52 bits of an MD5."""
    hashed = F.md5(F.encode(F.concat(F.lit(seed + ":"), F.coalesce(identity.cast("string"), F.lit("null"))), "utf-8"))
    u = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to (__source, source_size): all words shared by weight, none above max_epochs times a source.

    Sources in code-point order, null last, take the weights in turn. What a full source can't
    take is shared by weight among the others; here in closed form, over the sources in order of
    the level at which each is full. The table has a row per source, so its windows are small.
    """
    order = W.orderBy(F.col("__source").isNull(), "__source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    df = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    df = df.withColumn("__cap", F.col("source_size") * F.lit(max_epochs)).withColumn("__full", F.col("__cap") / F.col("__w"))
    by_level = W.orderBy("__full", F.col("__source").isNull(), "__source")
    rest = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumn("__at", F.row_number().over(by_level)).withColumn("__total", F.sum("source_size").over(whole))
    capped = F.coalesce(F.sum("__cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("__level", (F.col("__total") - capped) / F.sum("__w").over(rest))
    first = F.min(F.when(F.col("__level") <= F.col("__full"), F.struct("__at", "__level"))).over(whole)
    level = F.coalesce(first["__level"], F.col("__full"))
    return df.select("__source", "source_size", F.least(F.col("__cap").cast("double"), level * F.col("__w")).alias("target"))


def mix(df: DataFrame, source: Column, size: Column, identity: Column, quality: Column, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, keep: bool = True) -> DataFrame:
    """``df`` with source_size, target, copies (whole ones, int), part (words of one more, long) and taken (long).

    Every row stays; a row the mix leaves out has taken = 0. The document that the budget ends in
    gives its first ``part`` words. Null sources are a source of their own, sizes of null count
    as 0, weights of null as 1; repeated rows are rows of their own; an empty table gives none.
    With ``keep`` the table is written to the shared folder once, so it should be narrow; without,
    it is read three times, and texts may ride along. Its columns must not start with __; those
    named as the new ones are replaced.
    """
    weight = F.coalesce(quality.cast("double"), F.lit(1.0))
    key = exponential_key(identity, weight, seed)
    names = [c for c in df.columns if c not in ("source_size", "target", "copies", "part", "taken")]
    base = df.select(*[F.col(f"`{c}`") for c in names], source.alias("__source"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("__size"), key.alias("__key"), identity.alias("__id"))
    bucket = F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("__key"))) * BUCKETS).cast("int"))
    base = base.withColumn("__bucket", bucket)
    if keep:
        base = scratch.materialize(base, "mix_base")
    sums = base.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__sum"))
    goal = targets(sums.groupBy("__source").agg(F.sum("__sum").alias("source_size")), weights, max_epochs)
    some = F.col("source_size") > 0
    goal = goal.withColumn("__epochs", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = goal.withColumn("__budget", F.floor(F.col("target") - F.col("__epochs") * F.col("source_size")).cast("long"))
    running = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(running), F.lit(0).cast("long")))
    ends = starts.join(goal, starts["__source"].eqNullSafe(goal["__source"])).drop(goal["__source"])
    end = ends.groupBy("__source").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "__epochs", "__budget")],
        F.max(F.when(F.col("__start") <= F.col("__budget"), F.struct("__bucket", "__start"))).alias("__end"),
    )
    end = end.select(F.col("__source").alias("__s"), "source_size", "target", "__epochs", "__budget", F.col("__end.__bucket").alias("__last"), F.col("__end.__start").alias("__start"))
    end = scratch.materialize(end, "mix_sources")
    if end.count() <= BROADCAST_SOURCES:
        end = F.broadcast(end)
    rows = base.join(end, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    before = W.partitionBy("__source").orderBy("__key", "__id", "__size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("__budget") - F.col("__start") - F.coalesce(F.sum("__size").over(before), F.lit(0))
    at_end = rows.where("__bucket = __last").withColumn("__got", F.greatest(F.lit(0).cast("long"), F.least(F.col("__size"), left)))
    others = rows.where("__bucket <> __last").withColumn("__got", F.when(F.col("__bucket") < F.col("__last"), F.col("__size")).otherwise(0))
    got = others.unionByName(at_end)
    whole = (F.col("__got") == F.col("__size")) & (F.col("__size") > 0)
    return got.select(
        *[F.col(f"`{c}`") for c in names], "source_size", "target",
        (F.col("__epochs") + whole.cast("int")).alias("copies"),
        F.when(whole, 0).otherwise(F.col("__got")).cast("long").alias("part"),
        (F.col("__epochs") * F.col("__size") + F.col("__got")).cast("long").alias("taken"),
    )


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, weight) of the labelled documents; one row for each id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    weight = F.lit(UNLABELLED)
    for q, w in QUALITY.items():
        weight = F.when(F.col("q") == q, F.lit(w)).otherwise(weight)
    return labels.select(F.col("doc_id").alias("__doc"), weight.alias("__quality"))


def plain_quality(text: Column, size: Column) -> Column:
    """A sampling weight without labels: documents whose words have an ordinary mean length weigh QUALITY[1], others QUALITY[0]."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(mean.between(3.0, 14.0), F.lit(QUALITY[1])).otherwise(F.lit(QUALITY[0]))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as the mix takes it whole, with the columns of ``docs``.

    Documents stay whole: the one that a source's budget ends in is taken if at least half of it fits.
    """
    own = {c: f"doc_{c}" for c in docs.columns}  # no name of the mix is one of these
    rows = docs.withColumnsRenamed(own).withColumn("mix_words", word_count(F.col("doc_text")))
    out = mix(rows, F.col("doc_source"), F.col("mix_words"), F.col("doc_doc_id"), plain_quality(F.col("doc_text"), F.col("mix_words")), keep=False)
    times = F.col("copies") + F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("mix_words")), 1).otherwise(0)
    out = out.where(times > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), times)))
    return out.select(*[F.col(f"`{new}`").alias(c) for c, new in own.items()])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words that a mix of the sources takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    labelled = quality_weights(spark, sf_dir)
    docs = docs.join(labelled, docs["doc_id"] == labelled["__doc"], "left")
    narrow = docs.select("doc_id", "source", "size", F.col("__quality").alias("quality"))
    out = mix(narrow, F.col("source"), F.col("size"), F.col("doc_id"), F.col("quality"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


_SQL = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         -ln((cast('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint) + 0.5) / 4503599627370496.0)
           / (case coalesce(q, -1) when 1 then 2.0 when 0 then 0.5 else 1.0 end) as k
  from documents left join (select doc_id as i, max(quality) as q from labels group by 1) on doc_id = i),
s as (
  select source, sum(size)::bigint as source_size,
         (((row_number() over (order by source is null, source)) - 1) % 3 + 1)::double as w
  from d group by source),
f as (select *, source_size * 3 as cap, source_size * 3 / w as full_at from s),
o as (
  select *, row_number() over l as pos,
         ((sum(source_size) over ()) - coalesce(sum(cap) over (l rows between unbounded preceding and 1 preceding), 0))::double
           / (sum(w) over (l rows between current row and unbounded following)) as level
  from f window l as (order by full_at, source is null, source)),
t as (
  select source, source_size,
         least(cap::double, (select level from o where level <= full_at order by pos limit 1) * w) as target
  from o),
e as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs,
         floor(target - (case when source_size > 0 then floor(target / source_size) else 0 end) * source_size)::bigint as budget
  from t),
c as (
  select d.doc_id, d.size, e.source_size, e.target, e.epochs,
         e.budget - coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as rest
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest)))::bigint as taken from c
"""

QUERIES = {"op5_mix_sources": op5_mix_sources}
ORACLE_SQL = {"op5_mix_sources": _SQL}
