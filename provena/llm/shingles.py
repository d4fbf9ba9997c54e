"""Hashed word shingles of whole texts, in numpy.

Bytes are lower-cased (A-Z only) and cut into words at the six ASCII white-space characters.
A word's hash is a polynomial of random 64-bit values of its bytes, read off running sums; a
shingle's hash mixes those of its words. Work goes in slices of about SLICE_BYTES that end
between words, so memory is bounded for texts of any length but for a set's own hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 2**62)) * 2 + 1
_TURNS = [(int(x) * 2 + 1) % 2**64 for x in _rng.integers(0, 2**62, 64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_UP = _powers(_BASE, SLICE_BYTES + 1)
_DOWN = _powers(pow(_BASE, -1, 2**64), SLICE_BYTES + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from starts and ends to the polynomial hashes of these stretches of 64-bit values."""
    n = len(values)
    up, down = (_UP, _DOWN) if n <= SLICE_BYTES else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2**64), n + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return lambda starts, ends: (sums[ends] - sums[starts]) * down[starts]


def _slice_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of at most a slice (a longer single word has slices of its own powers)."""
    solid = ~_SPACE[data]
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, mix(span_hashes(_VALUE[_LOWER[data]])(starts, ends))


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(data)
    while at < n:
        end = min(at + SLICE_BYTES, n)
        if end < n:
            back = np.flatnonzero(_SPACE[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                while end < n and not _SPACE[data[end]]:
                    end += 1
        yield at, end
        at = end


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's word hashes, in order."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush() -> None:
        if held:
            lengths = np.array([len(t) + 1 for t in held])
            starts, hashes = _slice_words(np.frombuffer(b"\n".join(held) + b"\n", np.uint8))
            out.extend(np.split(hashes, np.searchsorted(starts, np.cumsum(lengths)[:-1])))
            held.clear()

    size = 0
    for text in texts:
        if size + len(text) + 1 > SLICE_BYTES:
            flush()
            size = 0
        if len(text) + 1 > SLICE_BYTES:
            data = np.frombuffer(text, np.uint8)
            out.append(np.concatenate([_slice_words(data[a:b])[1] for a, b in _cuts(data)]))
        else:
            held.append(text)
            size += len(text) + 1
    flush()
    return out


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words are one run; none give none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(width, n)
    out = np.full(n - k + 1, _TURNS[k], np.uint64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * np.uint64(_TURNS[20 + i])
    return np.unique(mix(out))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set, from its size, its sum and its exclusive or."""
    if not len(hashes):
        return 0
    again = mix(hashes + np.uint64(_TURNS[50]))
    seed = np.array([len(hashes)], np.uint64) * np.uint64(_TURNS[51]) + again.sum(dtype=np.uint64, keepdims=True)
    both = np.bitwise_xor.reduce(again, keepdims=True) * np.uint64(_TURNS[52])
    return int(mix(mix(seed) ^ both).view(np.int64)[0])
