"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting takes at most MAX_TOXIC and MAX_CLEAN labelled rows, those with the smallest hash of
their ids, as long as they have MAX_TERMS terms together. A text's terms are its words and word
heads of HEADS letters. All terms of the examples are indexed, whatever class they stand for. A
term weighs (1 + ln tf) * idf * its contrast, the two-sided z of its rates in the classes, and
each text's weights are cosine-normed over all its known terms.

The index has bounded size and is broadcast; scoring is one pass over whole texts without a
shuffle. Examples lie in blocks of BLOCK, ordered by their heaviest term. A few queries go
together: rare terms' postings are added up, common terms are a matrix product for each block,
and blocks come in falling order of their upper bound, from the maxima of the block. A block
that can't hold a nearer example of a query is skipped for it, so the K nearest are exact (to
single precision). Votes weighted by similarity are calibrated by a logistic curve fitted to
leave-one-out votes, with each class at its frequency among all labelled rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.llm import batches, scratch
from provena.llm.shingles import SLICE_BYTES, mix, span_hashes

#: Labelled rows of either class that fit() takes, at most, unless it is told otherwise.
MAX_TOXIC = 1000
MAX_CLEAN = 2000
#: Terms of all examples together; examples beyond that, in order of hash, are left out.
MAX_TERMS = 5_000_000
K = 25
BLOCK = 64
#: Blocks after which a query's bounds are compared anew, and what rounding may add to a score.
TILE = 8
SLACK = 1e-5
#: Terms that more than this share of the examples have are common. Queries that go together.
COMMON = 0.06
TOGETHER = 64
HEADS = (4, 5, 6, 7)
#: Similarity that the prior counts as, among a query's neighbours.
PRIOR_MASS = 0.25
HELD_OUT = 5
#: Examples that op10 lists as evidence.
SHOWN = 3

_HEAD = np.uint64(0x5851F42D4C957F2D)
_POINT = np.uint64(0x2545F4914F6CDD1D)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _pieces(text: str) -> Iterator[str]:
    """Stretches of about SLICE_BYTES characters that end between words."""
    at = 0
    while at < len(text):
        end = min(at + SLICE_BYTES, len(text))
        if end < len(text):
            back = end
            while back > at and text[back - 1].isalpha():
                back -= 1
            while back == at and end < len(text) and text[end].isalpha():
                end += 1
            end = back if back > at else end
        yield text[at:end]
        at = end


def _slice_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the terms of a slice; a place is where a term's word starts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = _is_letter()[points]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    spans = span_hashes(mix((points.astype(np.uint64) + np.uint64(1)) * _POINT) | np.uint64(1))
    places, hashes = [starts], [mix(spans(starts, ends))]
    for k in HEADS:
        longer = starts[ends - starts > k]
        places.append(longer)
        hashes.append(mix(spans(longer, longer + k) ^ _HEAD))
    return np.concatenate(places), np.concatenate(hashes)


def terms(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes of each text's lower-cased words and the heads of longer ones, with counts; null has none.

    Short texts are read together; of a text longer than a slice, the slices' counts are summed.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            places, hashes = _slice_terms("\n".join(held))
            owner = np.searchsorted(np.cumsum([len(t) + 1 for t in held]), places, side="right")
            by = np.argsort(owner, kind="stable")
            hashes = hashes[by]
            cuts = np.searchsorted(owner[by], np.arange(len(held) + 1))
            out.extend(np.unique(hashes[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            held.clear()

    size = 0
    for text in texts:
        text = (text or "").lower()
        if size + len(text) + 1 > SLICE_BYTES:
            flush()
            size = 0
        if len(text) >= SLICE_BYTES:
            keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for piece in _pieces(text):
                more, n = np.unique(_slice_terms(piece)[1], return_counts=True)
                keys, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
            out.append((keys, counts))
        else:
            held.append(text)
            size += len(text) + 1
    flush()
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


@dataclass
class Index:
    """Postings of rare terms, and blocks of a matrix of common ones with each block's maxima."""

    keys: np.ndarray  # hashes of the terms, sorted
    factors: np.ndarray  # idf times contrast, by term
    row: np.ndarray  # of a common term in the blocks; -1: a rare one
    first: np.ndarray  # of term t's postings: first[t] to first[t + 1]; common terms have none
    examples: np.ndarray  # by posting
    weights: np.ndarray
    blocks: np.ndarray  # block x common term x example
    top: np.ndarray  # common term x block: largest weight
    ids: np.ndarray  # doc_id, by example
    labels: np.ndarray
    prior: float
    curve: tuple[float, float] = (1.0, 0.0)
    _sent: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_sent": []}

    def broadcast(self, spark: SparkSession):
        """This index on all workers; sent once in an application."""
        if not self._sent or self._sent[0] != spark.sparkContext.applicationId:
            self._sent[:] = [spark.sparkContext.applicationId, spark.sparkContext.broadcast(self)]
            batches.trim()  # what pickling held
        return self._sent[1]

    def vector(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and cosine-normed weights of a text's terms; those that no example has are left out."""
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0)
        t = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[t] == keys
        t = t[known]
        w = (1 + np.log(counts[known])) * self.factors[t]
        length = np.linalg.norm(w)
        return (t, w / length) if length > 0 else (np.zeros(0, np.int64), np.zeros(0))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query, cosines and numbers of the k examples with the highest cosine over 0, ties to smaller numbers."""
        out = []
        for at in range(0, len(vectors), TOGETHER):
            out += self._nearest(vectors[at : at + TOGETHER], k, without[at : at + TOGETHER] if without else None)
        return out

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """As nearest(), of few queries. What rare terms give is exact; what common ones can add in a block is bounded by its maxima."""
        n, count = len(self.blocks), len(vectors)
        if not n:
            return [(np.zeros(0), np.zeros(0, np.int64))] * count
        asked = np.zeros((TOGETHER, len(self.top)), np.float32)
        rare = np.zeros((count, n * BLOCK))
        for i, (t, w) in enumerate(vectors):
            row = self.row[t]
            common = row >= 0
            asked[i, row[common]] = w[common]
            t, w = t[~common], w[~common]
            m = self.first[t + 1] - self.first[t]
            p = _ranges(self.first[t], m)
            rare[i] = np.bincount(self.examples[p], weights=np.repeat(w, m) * self.weights[p], minlength=n * BLOCK)
        if without is not None:
            rare[np.arange(count), without] = -np.inf
        bound = rare.reshape(count, n, BLOCK).max(axis=2) + (asked @ self.top)[:count]
        best = np.partition(np.concatenate([rare, np.zeros((count, k))], axis=1), -k, axis=1)[:, -k:]  # k examples reach its least already
        best = np.maximum(best, 0.0)
        score = np.full((count, n * BLOCK), -1.0)
        order = np.argsort(-bound.max(axis=0), kind="stable")
        for at in range(0, n, TILE):
            least = best.min(axis=1)
            new = np.full((count, TILE * BLOCK), -1.0)
            for j, b in enumerate(order[at : at + TILE]):
                live = (bound[:, b] > 0) & (bound[:, b] >= least - SLACK)
                if live.any():
                    cols = slice(b * BLOCK, (b + 1) * BLOCK)
                    own = rare[:, cols] + (asked @ self.blocks[b])[:count]
                    score[live, cols] = own[live]
                    new[live, j * BLOCK : (j + 1) * BLOCK] = own[live]
            reached = np.partition(new, -k, axis=1)[:, -k:] if at == 0 else np.partition(np.concatenate([reached, new], axis=1), -k, axis=1)[:, -k:]
            best = np.maximum(reached.min(axis=1, keepdims=True), best.min(axis=1, keepdims=True))
        out = []
        for row, least in zip(score, reached.min(axis=1), strict=True):
            some = np.flatnonzero((row > 0) & (row >= least))
            some = some[np.lexsort((some, -row[some]))[:k]]
            out.append((row[some], some))
        return out

    def vote(self, scores: np.ndarray, found: np.ndarray) -> float:
        """Share of similarity on toxic examples, with the prior as one more voter."""
        return float((scores @ self.labels[found] + PRIOR_MASS * self.prior) / (scores.sum() + PRIOR_MASS))

    def score(self, vote: float) -> float:
        a, b = self.curve
        v = min(max(vote, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(a * math.log(v / (1 - v)) + b)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, drawn a little to (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + (a - 1), (weight * (p - y)).sum() + 0.1 * b])
        r = weight * p * (1 - p)
        h = np.array([[(r * x * x).sum() + 1, (r * x).sum()], [(r * x).sum(), r.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.05)), float(b)


def contrast(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How surely a term's rates differ between the classes, either way: the absolute z of a in n1 and b in n0. One class only: 1."""
    if not n1 or not n0:
        return np.ones(len(a))
    both = (a + b) / (n1 + n0)
    return np.abs(a / n1 - b / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-9)


def build(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list[int], prior: float) -> Index:
    """An index of examples given as sorted term hashes and counts."""
    y = np.array(labels, np.int64)
    sizes = np.array([len(k) for k, _ in bags], np.int64)
    # The driver builds this, so columns are as narrow as they can be, and few are held at once.
    keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in bags]])
    keys.sort()
    keys = keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]
    term = np.concatenate([np.zeros(0, np.int32), *[np.searchsorted(keys, k).astype(np.int32) for k, _ in bags]])
    example = np.repeat(np.arange(len(bags), dtype=np.int32), sizes)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    df = np.bincount(term, minlength=len(keys))
    toxic = np.bincount(term[y[example] == 1], minlength=len(keys))
    factors = (np.log((1 + len(y)) / (1 + df)) + 1) * contrast(toxic, df - toxic, n1, n0)
    weight = np.concatenate([np.zeros(0), *[c for _, c in bags]])
    np.log(weight, out=weight)
    weight += 1
    ends = np.cumsum(sizes)
    heaviest = np.zeros(len(bags), np.int64)
    for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
        own = weight[a:b]
        own *= factors[term[a:b]]
        own /= max(np.sqrt(np.bincount(np.zeros(b - a, np.int8), weights=own * own, minlength=1)[0]), 1e-300)
        if b > a:
            heaviest[i] = term[b - 1 - np.argmax(own[::-1])]
    # Examples with the same heaviest term are neighbours.
    order = np.lexsort((np.array(ids, np.int64), heaviest))
    place = np.empty(len(bags), np.int32)
    place[order] = np.arange(len(bags))
    example, weight = place[example], weight.astype(np.float32)
    by = np.lexsort((example, term))
    term, example, weight = term[by], example[by], weight[by]
    del by
    common = df > COMMON * len(bags)
    row = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
    often = common[term]
    blocks = np.zeros((-(-len(bags) // BLOCK), int(common.sum()), BLOCK), np.float32)
    blocks[example[often] // BLOCK, row[term[often]], example[often] % BLOCK] = weight[often]
    term, example, weight = term[~often], example[~often], weight[~often]
    first = np.searchsorted(term, np.arange(len(keys) + 1)).astype(np.int32)
    return Index(keys, factors, row, first, example.astype(np.int32), weight, blocks, blocks.max(axis=2, initial=0).T.copy(), np.array(ids, np.int64)[order], y[order], prior)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from learning: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % HELD_OUT == 0


def crc_held_out(doc_id: int) -> bool:
    """held_out() for one id, in Python."""
    return zlib.crc32(str(doc_id).encode()) % HELD_OUT == 0


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        bags = terms(part.column(2).to_pylist())
        cells = [pa.array([x.astype(t).tobytes() for x in column], pa.binary()) for column, t in zip(zip(*bags, strict=True), ("<u8", "<i4"), strict=True)] if bags else [pa.array([], pa.binary())] * 2
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(k) for k, _ in bags], pa.int64()), *cells], ["doc_id", "toxic", "terms", "keys", "counts"])
    batches.trim()


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_terms: int = MAX_TERMS) -> Index:
    """Learn from (doc_id, text) and (doc_id, toxic); held-out, null and unknown labels are left out.

    At most ``max_toxic`` and ``max_clean`` rows of the two classes are examples, of at most
    ``max_terms`` terms together; the index, which every task holds, grows with them.
    An id with several labels counts as toxic if any says so; of several texts with one id the
    smallest is the example. Null texts are none. Without labels of both classes the index only
    knows the prior. Ties of the sampling hash go to the smaller id.
    """
    spark = docs.sparkSession
    batches.bound(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_clean))
    sample = sample.select(F.col("doc_id").alias("__id"), "toxic")  # at most max_toxic + max_clean rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).where("text is not null")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    packed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(_packed, "doc_id long, toxic int, terms long, keys binary, counts binary")
    packed = scratch.materialize(packed, "toxicity_examples")
    so_far = F.sum("terms").over(W.orderBy(*order))  # a row per example: as few as the sample
    chosen = packed.select("doc_id", so_far.alias("so_far"), *order[:1]).where(F.col("so_far") <= max_terms).select(F.col("doc_id").alias("__id"))
    found = packed.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).drop("__id").orderBy("doc_id").toArrow()
    bags = [(np.frombuffer(k.as_buffer(), "<u8"), np.frombuffer(c.as_buffer(), "<i4")) for k, c in zip(found.column("keys"), found.column("counts"), strict=True)]  # no copies
    ys = found.column("toxic").to_pylist()
    if len(set(ys)) < 2:
        return build([], [], [], prior)
    index = build(bags, ys, found.column("doc_id").to_pylist(), prior)
    del found, bags
    batches.trim()
    pa.default_memory_pool().release_unused()
    index.curve = _calibrated(index, packed, counts)
    scratch.drop(packed)
    return index


def _calibrated(index: Index, packed: DataFrame, counts: dict[int, int]) -> tuple[float, float]:
    """The curve of leave-one-out votes, which tasks work out; a number for each example reaches the driver."""
    shared = index.broadcast(packed.sparkSession)

    def vote(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        number = {d: i for i, d in enumerate(index.ids.tolist())}
        for part in parts:
            ids, ys, keys, ns = ([*part.column(c).to_pylist()] for c in (0, 1, 3, 4))
            own = [i for i, d in enumerate(ids) if d in number]
            vectors = [index.vector(np.frombuffer(keys[i], "<u8"), np.frombuffer(ns[i], "<i4")) for i in own]
            votes = [index.vote(*near) for near in index.nearest(vectors, without=[number[ids[i]] for i in own])]
            yield pa.RecordBatch.from_arrays([pa.array([ys[i] for i in own], pa.int32()), pa.array(votes, pa.float64())], ["toxic", "vote"])
        batches.trim()

    votes = packed.mapInArrow(vote, "toxic int, vote double").orderBy("vote", "toxic").toArrow()
    y, v = votes.column("toxic").to_numpy(), np.clip(votes.column("vote").to_numpy(), 1e-6, 1 - 1e-6)
    share = np.bincount(y, minlength=2)
    # The sample's classes count as often as all labelled rows have them; the sum of weights stays.
    real = np.array([counts.get(0, 0), counts.get(1, 0)]) / max(1, sum(counts.values())) * len(y) / np.maximum(share, 1)
    return _logistic(np.log(v / (1 - v)), y.astype(float), real[y])


def score(docs: DataFrame, index: Index, text: str = "text", evidence: bool = False, into: str = "toxicity") -> DataFrame:
    """``docs`` with a score (double, 0 to 1) in column ``into`` and, if asked, ``evidence``.

    Evidence lists the nearest examples, nearest first: doc_id, toxic, cosine. Texts are read
    whole, however long. Null and empty texts, and those with no indexed term, get the score of
    the prior and no evidence. Repeated rows are scored each, equal texts equally; an empty table
    gives none. Columns named as the results are replaced; all others pass as they are, whatever
    their names.
    """
    batches.bound(docs.sparkSession)
    shared, curve = index.broadcast(docs.sparkSession), index.curve
    fields = [pa.field("doc_id", pa.int64()), pa.field("toxic", pa.int32()), pa.field("cosine", pa.float64())]

    @F.arrow_udf("struct<score:double,evidence:array<struct<doc_id:bigint,toxic:int,cosine:double>>>")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        index.curve = curve
        prior = index.score(index.prior)
        for part in parts:
            out, seen, cosines = [], [], []
            vectors = [index.vector(*bag) for bag in terms(part.to_pylist())]
            for near in index.nearest(vectors):
                out.append(index.score(index.vote(*near)) if len(near[0]) else prior)
                if evidence:
                    cosines.append(near[0])
                    seen.append(near[1])
            offsets = np.zeros(len(out) + 1, np.int32)
            np.cumsum([len(x) for x in seen] if evidence else [0] * len(out), out=offsets[1:])
            of = np.concatenate([np.zeros(0, np.int64), *seen])
            why = pa.StructArray.from_arrays([pa.array(index.ids[of]), pa.array(index.labels[of].astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *cosines]))], fields=fields)
            yield pa.StructArray.from_arrays([pa.array(out, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), why)], ["score", "evidence"])
        batches.trim()

    new = {into: "score"} | ({"evidence": "evidence"} if evidence else {})
    (held,) = batches.free_names(docs, "scored")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    return docs.withColumn(held, scored(F.col(f"`{text}`"))).select(*keep, *[F.col(f"`{held}`")[c].alias(name) for name, c in new.items()])


def op10_toxicity(spark: SparkSession, sf_dir: str, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_terms: int = MAX_TERMS) -> DataFrame:
    """Every document's toxicity, with its nearest labelled examples. The bounds are those of fit()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), max_toxic, max_clean, max_terms)
    out = score(docs, index, evidence=True)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.slice("evidence", 1, SHOWN).alias("evidence"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}
