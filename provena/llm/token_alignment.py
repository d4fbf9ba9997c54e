"""Alignment of two tokenizers' tokens over the bytes of the same texts, and the corpus's counts of their links.

A is a byte-level BPE of a tokenizer file, B a SentencePiece BPE with byte fallback. The starts
and ends of B's tokens are a static interval index; every A token stabs it by bisection at both
of its ends and so lists the B tokens that it overlaps. What lists span is summed up over the
gaps between B tokens; a gap that none spans is where a group ends.

Both tokenizers break a text at every single space between two other characters: no token of
either holds a space after something else. Such stretches are aligned once while a task
remembers them, by the thousand in one set of arrays, and a text is put together from them.

An id pair's count needs the whole corpus. Texts keep their distinct pairs with multiplicities;
the counts are summed in Spark, and come back to the texts in two ways: the most frequent pairs,
at most HOT of them, are broadcast; all others meet the texts in a shuffled join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import batches, scratch

FILE_A = "/opt/tokenizers/byte_bpe_50k.json"
FILE_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Most id pairs whose counts are broadcast (about 16 MB); all others are joined.
HOT = 1 << 18
#: Characters of a text that are aligned at once, and stretches that a task remembers.
SLICE = 1 << 20
ROOM = 1 << 17

#: Fixed value: how the byte-level tokenizer cuts a text into words before it merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that every token of either tokenizer begins at.
CUT = re.compile(r"(?<=\S) (?=\S)")
MARK = "▁"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers of one worker, and the stretches that it has aligned lately."""

    def __init__(self, file_a: bytes, file_b: bytes) -> None:
        import sentencepiece
        import tiktoken

        a = json.loads(file_a)
        model, words = a["model"], a.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or a.get("normalizer") or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True):
            raise ValueError("tokenizer A must be a byte-level BPE without a normalizer")
        letters, special = _byte_letters(), {t["content"] for t in a.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(model["vocab"][x] >= model["vocab"][y] for x, y in zip(merged, merged[1:], strict=False)):
            raise ValueError("tokenizer A must number its tokens in the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(model["vocab"].values()) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("no piece of tokenizer B may hold a space after something else")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        n, m = len(self.bytes_a), len(self.bytes_b)
        self.signs = [f"{i}{end}" for end, size in ((",", n), ("|", n), (",", m), (";", m)) for i in range(size)]
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, links; -1 where the bytes differ
        self.at = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def learn(self, stretches: list[str]) -> None:
        """Align stretches, each with a space in front, and remember them."""
        ids_a = [self.a.encode_ordinary(f" {s}") for s in stretches]
        ids_b = self.b.encode(stretches, num_threads=1)
        counts = np.full((len(stretches), 4), -1, np.int64)
        fine = []
        for k, s in enumerate(stretches):
            want = f" {s}".encode()
            if b"".join(map(self.bytes_a.__getitem__, ids_a[k])) == want == b"".join(map(self.bytes_b.__getitem__, ids_b[k])):
                fine.append(k)
        groups, at, links = [""] * len(stretches), np.zeros(len(stretches), np.int64), np.zeros(0, np.int64)
        if fine:
            links = self._align(fine, [ids_a[k] for k in fine], [ids_b[k] for k in fine], counts, groups, at)
        base = len(self.groups)
        self.slot.update((s, base + k) for k, s in enumerate(stretches))
        self.groups += groups
        self.counts = np.concatenate([self.counts, counts])
        self.at = np.concatenate([self.at, at + len(self.links)])
        self.links = np.concatenate([self.links, links])

    def _align(self, which: list[int], ids_a: list, ids_b: list, counts: np.ndarray, groups: list[str], at: np.ndarray) -> np.ndarray:
        """All stretches behind each other on one axis of bytes; fills in counts, groups and at, and returns the links as pair numbers."""
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # the index: B's tokens by start and by end; A's tokens stab it at both ends
        first = np.searchsorted(ends_b, ends_a - self.size_a[a], "right")
        after = np.searchsorted(ends_b - self.size_b[b], ends_a, "left")
        spans = np.bincount(first, minlength=len(b) + 1) - np.bincount(after - 1, minlength=len(b) + 1)
        ends = np.cumsum(spans)[: len(b)] == 0  # no list goes on to the next B token
        group_b = np.cumsum(ends) - ends
        group_a = group_b[first]
        # order of writing: each group's A ids, then its B ids
        before_b, before_a = np.searchsorted(group_b, group_a, "left"), np.searchsorted(group_a, group_b, "right")
        signs = np.empty(len(a) + len(b), np.int64)
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        sizes = len(self.bytes_a), len(self.bytes_b)
        signs[np.arange(len(a)) + before_b] = a + last_a * sizes[0]
        signs[np.arange(len(b)) + before_a] = b + 2 * sizes[0] + ends * sizes[1]
        spelt, lap = list(map(self.signs.__getitem__, signs.tolist())), after - first
        upto = np.cumsum(n_a + n_b)
        for k, i, j in zip(which, (upto - n_a - n_b).tolist(), upto.tolist(), strict=True):
            groups[k] = "".join(spelt[i:j])
        sums = lambda x, n: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], np.cumsum(n)))])
        n_links = sums(lap, n_a)
        counts[which] = np.stack([n_a, n_b, sums(ends, n_b), n_links], 1)
        at[which] = np.cumsum(n_links) - n_links
        total = np.cumsum(lap)
        to = np.arange(int(total[-1])) - np.repeat(total - lap - first, lap)
        return np.repeat(a, lap) * sizes[1] + b[to]

    def texts(self, texts: list[str]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray] | None]:
        """Each text's four counts, groups, and distinct pair numbers with their multiplicities; None if bytes differ or there are none."""
        out: list = [None if not t else [] for t in texts]
        held, size = [], 0
        for k, text in enumerate(texts):
            at = 0
            while text and at <= len(text):
                m = CUT.search(text, at + SLICE) if at + SLICE < len(text) else None
                end = m.start() if m else len(text)
                held.append((k, CUT.split(text[at:end])))
                size, at = size + end - at, m.end() if m else len(text) + 1
                if size >= SLICE:
                    self._flush(held, out)
                    size = 0
        self._flush(held, out)
        return [f and self._joined(f) for f in out]

    def _flush(self, held: list[tuple[int, list[str]]], out: list) -> None:
        """Append what was found in each slice to its text's parts; None in place of all parts if bytes differ."""
        if len(self.slot) > ROOM or len(self.links) > 16 * ROOM:
            self.forget()
        if new := [s for s in dict.fromkeys(s for _, stretches in held for s in stretches) if s not in self.slot]:
            self.learn(new)
        for k, stretches in held:
            if out[k] is None:
                continue
            where = np.fromiter(map(self.slot.__getitem__, stretches), np.int64, len(stretches))
            kept, often = np.unique(where, return_counts=True)
            own = self.counts[kept]
            if (own[:, 0] < 0).any():
                out[k] = None
                continue
            n = own[:, 3]
            upto = np.cumsum(n)
            pairs, place = np.unique(self.links[np.arange(int(upto[-1])) + np.repeat(self.at[kept] - upto + n, n)], return_inverse=True)
            times = np.bincount(place, np.repeat(often, n))
            out[k].append((often @ own, "".join(map(self.groups.__getitem__, where.tolist())), pairs, times))
        held.clear()

    @staticmethod
    def _joined(parts: list) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        counts, groups, pairs, times = zip(*parts, strict=True)
        found, place = np.unique(np.concatenate(pairs), return_inverse=True) if len(pairs) > 1 else (pairs[0], np.arange(len(pairs[0])))
        return sum(counts), "".join(groups)[:-1], found, np.bincount(place, np.concatenate(times)).astype(np.int64)


_latest: list[tuple[int, Aligner]] = []


def _worker(shared) -> Aligner:
    """This worker's aligner: one, for the files that it used last."""
    key = hash(shared.value)
    if not _latest or _latest[0][0] != key:
        _latest[:] = [(key, Aligner(*shared.value))]
    return _latest[0][1]


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


NEW = ["n_a", "n_b", "n_groups", "n_links", "groups", "links"]


def align(df: DataFrame, text: str = "text", file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """``df`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (long), ``groups`` (string) and ``links``, in place of any such columns.

    ``groups`` lists the ids of each group, A's then B's: ``a1,a2|b1;a3|b2,b3``. ``links`` are
    the text's distinct id pairs, (pair, times), where pair is A's id times the size of B's
    vocabulary plus B's id. Texts that are null or empty, and those whose tokens don't spell a
    space and the text, have no tokens: zeros, an empty string, no links. Texts are taken whole,
    in slices of about SLICE characters. Repeated rows are rows of their own; an empty table
    gives none; other columns pass as they are, whatever their names. A pass without a shuffle;
    the tokenizers' files, read by the driver, are broadcast.
    """
    batches.bound(df.sparkSession)
    files = _bytes(file_a), _bytes(file_b)
    shared = df.sparkSession.sparkContext.broadcast(files)
    kind = "struct<n_a:long,n_b:long,n_groups:long,n_links:long,groups:string,links:array<struct<pair:long,times:int>>>"

    @F.arrow_udf(kind)
    def aligned(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = _worker(shared)
        for part in parts:
            found = aligner.texts([t or "" for t in part.to_pylist()])
            counts = np.array([f[0] if f else np.zeros(4, np.int64) for f in found], np.int64).reshape(-1, 4)
            sizes = [len(f[2]) if f else 0 for f in found]
            none = np.zeros(0, np.int64)
            pairs, times = (pa.array(np.concatenate([none, *[f[k] for f in found if f]]), kind) for k, kind in ((2, pa.int64()), (3, pa.int32())))
            links = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.StructArray.from_arrays([pairs, times], ["pair", "times"]))
            yield pa.StructArray.from_arrays([*[pa.array(counts[:, k]) for k in range(4)], pa.array([f[1] if f else "" for f in found], pa.string()), links], NEW)
        batches.trim()

    (held,) = batches.free_names(df, "aligned")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in NEW]
    return df.withColumn(held, aligned(F.col(f"`{text}`"))).select(*keep, *[F.col(f"`{held}`")[c].alias(c) for c in NEW])


def vocabulary(file_b: str = FILE_B) -> int:
    """The number of B's pieces, by which pair numbers are divided."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=_bytes(file_b)).get_piece_size()


def pair_counts(links: DataFrame, pieces: int) -> DataFrame:
    """(pair, n, best): how many links hold each pair, and whether no pair of the same B id has more.

    ``links`` has (pair, times). Sums are partial before the shuffle; the best counts of B's ids
    are at most ``pieces`` rows, so they can be broadcast.
    """
    pairs = links.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair") % pieces)
    best = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(pairs: DataFrame, most: int) -> tuple[int, int]:
    """The least count, a power of two, that at most ``most`` pairs reach; and how many do."""
    sizes = {r["k"]: r["count"] for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}  # at most 64 rows
    reached = 0
    for k in sorted(sizes, reverse=True):
        if reached + sizes[k] > most:
            return 2 ** (k + 1), reached
        reached += sizes[k]
    return 1, reached


def score(df: DataFrame, row_id: str = "doc_id", text: str = "text", file_a: str = FILE_A, file_b: str = FILE_B, hot: int = HOT) -> DataFrame:
    """(row_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``n_best`` counts a text's links whose pair is the most frequent of its B id over all texts,
    ``count_sum`` sums their pairs' counts. Texts without tokens have zeros and an empty hash.
    Aligned texts are written to the shared folder without their groups and read three times:
    for the counts, for the links of the frequent pairs, and for all others. A pair in every text
    is summed before it is shuffled, and is one of those broadcast; rows that repeat an id, or
    have none, keep rows of their own.
    """
    own = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    digest = F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    held = align(own, "text", file_a, file_b).select(F.monotonically_increasing_id().alias("row"), "id", "n_a", "n_b", "n_groups", "n_links", digest, "links")
    held = scratch.materialize(held, "aligned")
    links = held.select("row", F.explode("links").alias("link")).select("row", "link.pair", "link.times")
    pairs = scratch.materialize(pair_counts(links, vocabulary(file_b)), "pairs")
    least, _ = frequent(pairs, hot)
    top = F.broadcast(pairs.where(F.col("n") >= least))
    sums = lambda joined: joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    parts = sums(links.join(top, "pair"))
    if least > 1:
        parts = parts.unionByName(sums(links.join(top.select("pair"), "pair", "left_anti").join(pairs.where(F.col("n") < least), "pair")))
        parts = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = held.drop("links").join(parts, "row", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(row_id), "n_a", "n_b", "n_groups", "n_links", count("n_best"), count("count_sum"), "groups_sha256")


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned, with the corpus's counts of the links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, file_a=file_a, file_b=file_b)


QUERIES = {"op12_cross_tokenizer": op12_cross_tokenizer}
ORACLE_SQL: dict[str, str] = {}
