"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Texts are cut where no piece can cross: before a run of word marks, around line breaks, and in long
stretches without either between any two characters that stand together in no piece.
Distinct segments of equal length are rows of a matrix of code points and advance together:
at each place, substrings of every piece length are hashed from running sums, the hashes probe
the model's sorted keys, and the maximum over the lengths gives a row's backpointer.

The path's score depends on the model's type. For a unigram model it is the sum of the pieces'
scores. For a merge (BPE) model sums of scores are not what its merges maximise; there a step
is allowed where merging the two neighbouring pieces' text alone gives just these two pieces.
A sequence whose neighbours are all allowed is the merges' result, and there is one for each
prefix, so the same recursion finds it exactly. Unknown characters become byte pieces.
Where few long segments have a length, a step of numpy has too few rows to pay: the same recursion
goes through them one character at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Segments that a worker remembers; beyond that it forgets all. Places for pairs of neighbours that it remembers.
MEMORY = 200_000
PAIRS = 1 << 19
#: Rows of a matrix that advance together.
ROWS = 8192
#: Characters whose segments are held at a time; more make longer matrices, and fewer steps.
SLICE_CHARS = 3 << 20
#: Characters of a segment that is long, and how many of one length make a matrix.
LONG = 48
FEW = 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_UNIGRAM, _MERGES = 1, 2
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


@dataclass
class Model:
    """Pieces by hash; everything that a worker needs, without the file."""

    kind: int
    pieces: list[str]
    scores: np.ndarray
    types: list[int]
    dummy_prefix: bool
    unknown: int
    bytes_at: list[int]
    digest: str
    keys: np.ndarray = field(default=None)
    ids: np.ndarray = field(default=None)
    lengths: list[int] = field(default=None)

    def __post_init__(self) -> None:
        normal = [i for i, t in enumerate(self.types) if t == _NORMAL]
        self.lengths = sorted({len(self.pieces[i]) for i in normal})
        keys = np.zeros(len(normal), np.uint64)
        of = {n: [k for k, i in enumerate(normal) if len(self.pieces[i]) == n] for n in self.lengths}
        for n, own in of.items():
            for _, hashed in self.hashes(_code_points([self.pieces[normal[k]] for k in own]), n):
                keys[own] = hashed[:, 0]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        by = np.argsort(keys)
        self.keys, self.ids = keys[by], np.array(normal)[by]
        self.starts = np.searchsorted(self.keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        self.longest = int(np.diff(np.append(self.starts, len(self.keys))).max()) + 1
        self.starts = np.minimum(self.starts, len(self.keys) - 1)
        self.some = np.zeros(1 << 20, bool)  # leading bits of the keys: most substrings are no piece, and need no search
        self.some[self.keys >> np.uint64(44)] = True
        self.by_text = {self.pieces[i]: i for i in normal}
        inside = {p[k : k + 2] for p in self.by_text for k in range(len(p) - 1)}
        self.together = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in inside], np.int64))
        self.known_points = np.sort(np.array([ord(p) for p in self.by_text if len(p) == 1], np.int64))
        # Pieces that stand for their own text: all but the unknown piece and bytes above ASCII.
        self.odd = np.array([t == _UNKNOWN or (t == _BYTE and int(p[1:-1], 16) > 127) for p, t in zip(self.pieces, self.types, strict=True)])
        self.plain = [p.replace(MARK, " ") if t == _NORMAL else chr(int(p[1:-1], 16)) if t == _BYTE else "" for p, t in zip(self.pieces, self.types, strict=True)]
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(crossing.search(self.pieces[i]) for i in normal):
            raise ValueError("a piece crosses a word's start")
        self.breaks = "".join(c for c in "\n\t\r" if not any(c in self.pieces[i] for i in normal))
        # Marks that no piece has after a letter end a run of letters.
        ends = "".join(re.escape(c) for c in ".,;:!?)" if not any(re.search(rf"[^\W\d_]{re.escape(c)}", self.pieces[i]) for i in normal))
        self.segment = re.compile((rf"{MARK}*[^\W\d_]+(?=[{ends}])|" if ends else "") + f"{MARK}*[^{MARK}{self.breaks}]+|{MARK}+" + (f"|[{self.breaks}]" if self.breaks else ""))

    def parts(self, text: str) -> list[str]:
        """A stretch cut between characters that no piece has together; a run of unknown characters stays whole."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        cut = ~np.isin(points[:-1] << 21 | points[1:], self.together)
        if not self.bytes_at:
            known = np.isin(points, self.known_points)
            cut &= known[:-1] | known[1:]
        ends = [0, *(np.flatnonzero(cut) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    @staticmethod
    def hashes(points: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """(n, hashes of all substrings of n code points of each row) for n from 1; each from the shorter ones."""
        mixed = _mixed(points + np.uint64(1))
        out = np.zeros_like(mixed)
        for n in range(1, min(most, points.shape[1]) + 1):
            width = points.shape[1] - n + 1
            out = out[:, :width] * _FACTOR + mixed[:, n - 1 :]
            yield n, _mixed(out + np.uint64(n))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids by hash; -1 where there is none. Leading bits tell where in the sorted keys a search starts, and few keys share them."""
        out = np.full(hashes.shape, -1, np.int64)
        rows, cols = np.nonzero(self.some[hashes >> np.uint64(44)])
        wanted = hashes[rows, cols]
        at = self.starts[(wanted >> np.uint64(48)).astype(np.int64)]
        for _ in range(self.longest):
            key = self.keys[at]
            hit = key == wanted
            out[rows[hit], cols[hit]] = self.ids[at[hit]]
            on = np.flatnonzero(key < wanted)
            rows, cols, wanted, at = rows[on], cols[on], wanted[on], np.minimum(at[on] + 1, len(self.keys) - 1)
            if not len(on):
                break
        return out

    def merged(self, text: str) -> list[str]:
        """The merges' result on a short text: the best-scored neighbours join first, the left ones on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.by_text.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.scores[j] > best):
                    best, at = self.scores[j], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


def load(path: str = MODEL) -> Model:
    """Read a .model file, on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        data = f.read()
    proto.ParseFromString(data)
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models with the identity normalizer are supported")
    types = [p.type for p in proto.pieces]
    if proto.trainer_spec.model_type not in (_UNIGRAM, _MERGES) or any(t not in (1, 2, 3, 6) for t in types):
        raise ValueError("only unigram and merge models without user-defined pieces are supported")
    pieces = [p.piece for p in proto.pieces]
    at = {p: i for i, p in enumerate(pieces)}
    return Model(
        proto.trainer_spec.model_type, pieces, np.array([p.score for p in proto.pieces]), types, norm.add_dummy_prefix,
        types.index(_UNKNOWN), [at[f"<0x{b:02X}>"] for b in range(256)] if proto.trainer_spec.byte_fallback else [],
        hashlib.sha1(data).hexdigest(),
    )


class Codec:
    """Encoding and decoding with memory of segments and neighbours; one for each worker."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.pairs = np.full(PAIRS, -1, np.int64)  # neighbours by a hash's place, the last that came there
        self.answers = np.zeros(PAIRS, bool)
        self.alone: dict[int, bool] = {}  # the same for neighbours met one at a time

    def _allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the neighbours as they are. Ids; -1: an unknown character, -2: the text's start."""
        n = len(self.model.pieces) + 2
        keys = (left + 2) * n + (right + 2)
        place = (_mixed(keys.view(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        new = np.flatnonzero(self.pairs[place] != keys)
        out = self.answers[place]
        if len(new):
            names, back = np.unique(keys[new], return_inverse=True)
            found = np.ones(len(names), bool)
            for i, key in enumerate(names.tolist()):
                a, b = key // n - 2, key % n - 2
                if a != -1 and b != -1:
                    pieces = [self.model.pieces[x] for x in (a, b) if x >= 0]
                    found[i] = self.model.merged("".join(pieces)) == pieces
            out[new] = found[back]
            place = place[new]
            self.pairs[place], self.answers[place] = keys[new], found[back]
            # Two new neighbours may share a place: what stands there must be a pair and its own answer.
            self.answers[place] = found[np.searchsorted(names, self.pairs[place])]
        return out

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, as 32-bit integers."""
        m = self.model
        points = _code_points(words)
        rows, length = points.shape
        merges = m.kind == _MERGES
        found = {n: m.find(h) for n, h in m.hashes(points, m.lengths[-1]) if n in m.lengths}
        found = dict(reversed(found.items()))
        penalty = float(m.scores[m.ids].min()) - 10
        best = np.full((rows, length + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((rows, length + 1), -2, np.int64)  # the piece that ends here; -1: an unknown character
        back = np.zeros((rows, length + 1), np.int64)
        known_char = found[1] >= 0 if 1 in found else np.zeros(points.shape, bool)
        for end in range(1, length + 1):
            for n in (n for n in found if n <= end):
                ids = found[n][:, end - n]
                if merges:  # one candidate is allowed: rows that have theirs need no other
                    some = np.flatnonzero((ids >= 0) & (back[:, end] == 0))
                    some = some[self._allowed(last[some, end - n], ids[some])]
                    value = 1.0
                else:
                    some = np.flatnonzero(ids >= 0)
                    value = best[some, end - n] + m.scores[ids[some]]
                    better = value > best[some, end]
                    some, value = some[better], value[better]
                best[some, end], last[some, end], back[some, end] = value, ids[some], n
            lone = np.flatnonzero(~known_char[:, end - 1])
            value = 1.0 if merges else best[lone, end - 1] + penalty
            if merges:
                lone = lone[back[lone, end] == 0]
            else:
                better = value > best[lone, end]
                lone, value = lone[better], value[better]
            best[lone, end], last[lone, end], back[lone, end] = value, -1, 1
        if (back[:, 1:] == 0).any():
            raise ValueError("a segment has no path")
        # Backpointers of all rows are followed together, from the right.
        path = np.full((rows, length), 0, np.int64)
        at, step, every = np.full(rows, length), 0, np.arange(rows)
        counts = np.zeros(rows, np.int64)
        while (at > 0).any():
            step += 1
            ids, more = last[every, at], at > 0
            path[:, length - step] = np.where(ids >= 0, ids, np.where(more, -1 - points[every, np.maximum(at - 1, 0)].astype(np.int64), 0))
            counts += more
            at = at - back[every, at]
        odd = (path < 0).any(axis=1)
        narrow = path.astype(np.int32)
        return [self._spelt(path[r, length - c :].tolist()) if o else narrow[r, length - c :].tobytes() for r, c, o in zip(every.tolist(), counts.tolist(), odd.tolist(), strict=True)]

    def _viterbi_one(self, word: str) -> bytes:
        """As _viterbi(), of one long word, without a step of numpy for each character."""
        m, merges = self.model, self.model.kind == _MERGES
        get, scores, wide = m.by_text.get, m.scores, len(m.pieces) + 2
        lengths = m.lengths[::-1]
        penalty = float(m.scores[m.ids].min()) - 10
        best, last, back = [0.0] + [-np.inf] * len(word), [-2] * (len(word) + 1), [0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for n in lengths:
                i = get(word[end - n : end]) if n <= end else None
                if i is None:
                    continue
                if merges:
                    left = last[end - n]
                    if left != -1:
                        key = (left + 2) * wide + i
                        ok = self.alone.get(key)
                        if ok is None:
                            if len(self.alone) > 1 << 20:
                                self.alone.clear()
                            pieces = [m.pieces[x] for x in (left, i) if x >= 0]
                            ok = self.alone[key] = m.merged("".join(pieces)) == pieces
                        if not ok:
                            continue
                    last[end], back[end] = i, n
                    break
                value = best[end - n] + scores[i]
                if value > best[end]:
                    best[end], last[end], back[end] = value, i, n
            if get(word[end - 1]) is None and (not back[end] if merges else best[end - 1] + penalty > best[end]):
                best[end], last[end], back[end] = best[end - 1] + penalty, -1, 1
            if not back[end]:
                raise ValueError("a segment has no path")
        path, at = [], len(word)
        while at:
            path.append(last[at] if last[at] >= 0 else -1 - ord(word[at - 1]))
            at -= back[at]
        return self._spelt(path[::-1])

    def _spelt(self, ids: list[int]) -> bytes:
        """Unknown characters (-1 - code point) as byte pieces, or the unknown piece for each run of them."""
        out: list[int] = []
        for i, k in enumerate(ids):
            if k >= 0:
                out.append(k)
            elif self.model.bytes_at:
                out += [self.model.bytes_at[b] for b in chr(-1 - k).encode()]
            elif i == 0 or ids[i - 1] >= 0:
                out.append(self.model.unknown)
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text; texts of about SLICE_CHARS together are cut into segments at a time."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
                size += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        m = self.model
        cut = [m.segment.findall((MARK if m.dummy_prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        for segments in cut:
            if segments and max(map(len, segments)) > LONG:
                segments[:] = chain.from_iterable(m.parts(s) if len(s) > LONG else (s,) for s in segments)
        if len(self.known) > MEMORY:
            self.known.clear()
        by_length: dict[int, list[str]] = {}
        for s in set(chain.from_iterable(cut)).difference(self.known):
            by_length.setdefault(len(s), []).append(s)
        for words in by_length.values():
            if len(words[0]) > LONG and len(words) < FEW:
                self.known.update((w, self._viterbi_one(w)) for w in words)
                continue
            step = max(1, min(ROWS, (1 << 20) // len(words[0])))
            for at in range(0, len(words), step):
                part = words[at : at + step]
                self.known.update(zip(part, self._viterbi(part), strict=True))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, segments)), np.int32) for segments in cut]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; byte pieces that are no UTF-8 become replacement characters."""
        m, out, held = self.model, [], bytearray()
        ids = np.asarray(ids, np.int64)
        if not m.odd[ids].any():
            text = "".join(map(m.plain.__getitem__, ids.tolist()))
            return text[1:] if m.dummy_prefix and text.startswith(" ") else text
        for i in ids.tolist():
            t = m.types[i]
            if t == _BYTE:
                held.append(int(m.pieces[i][1:-1], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if t == _NORMAL:
                out.append(m.pieces[i])
            elif t == _UNKNOWN:
                out.append(f"{MARK}⁇{MARK}")
        text = "".join([*out, held.decode("utf-8", "replace")]).replace(MARK, " ")
        return text[1:] if m.dummy_prefix and text.startswith(" ") else text


_latest: list[Codec] = []


def _worker(shared) -> Codec:
    """This worker's codec: one, for the model that it used last, whichever broadcast brought it."""
    if not _latest or _latest[0].model.digest != shared.value.digest:
        _latest[:] = [Codec(shared.value)]
    return _latest[0]


def encode(df: DataFrame, model: Model, text: str = "text", verify: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array of int) in place of any such column; null texts get null, empty ones no ids.

    ``verify`` adds ``round_trip`` (boolean): the ids decode to the text again; it is true for
    nulls. Texts are encoded whole, however long. Repeated rows are encoded each; an empty table
    gives none; other columns pass as they are, whatever their names. A pass without a shuffle;
    the model, of the file's size, is broadcast.
    """
    batches.bound(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def encoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _worker(shared)
        for part in parts:
            texts = part.to_pylist()
            none = pa.array([t is None for t in texts])
            ids = codec.encode([t or "" for t in texts])
            same = [t is None or codec.decode(x) == t for t, x in zip(texts, ids, strict=True)] if verify else [None] * len(ids)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            lists = pa.ListArray.from_arrays(pa.array(offsets), values, mask=none)
            yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])
        batches.trim()

    new = ["ids", "round_trip"] if verify else ["ids"]
    (held,) = batches.free_names(df, "encoded")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in new]
    return df.withColumn(held, encoded(F.col(f"`{text}`"))).select(*keep, *[F.col(f"`{held}`")[c].alias(c) for c in new])


def decode(df: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (string) in place of any such column; null ids get null, no ids the empty string.

    Repeated rows are decoded each; an empty table gives none; other columns pass as they are.
    """
    batches.bound(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _worker(shared)
        for part in parts:
            yield pd.Series([None if x is None else codec.decode(x) for x in part], dtype=object)

    return df.withColumn("decoded", decoded(F.col(f"`{ids}`")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    """Every document's ids, and whether decoding them gives its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, load(model_path), verify=True)
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "round_trip")


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
