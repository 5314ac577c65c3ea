"""Vectorised views of UTF-8 texts: word spans, span hashes, window hashes.

Everything here works on one concatenated byte buffer plus document offsets, so that an
Arrow batch is read without making a Python object per word.  Hashes are 64 bits wide:
a polynomial over a table of random byte values, taken from prefix sums and finished by a
bit mixer.  Spans are hashed in groups of at most ``GROUP`` bytes, so temporary arrays stay
small whatever the length of a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

GROUP = 1 << 19
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _table(*unwanted: tuple[int, int]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    for low, high in unwanted:
        out[low : high + 1] = False
    return out


#: Bytes of words that white space ends, and of words that hold ASCII letters, digits and all above ASCII.
SPACED = _table((0x20, 0x20), (0x09, 0x0D))
ALNUM = _table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LINES = _table((0x0A, 0x0A))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits (finaliser of splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def seeded(h: np.ndarray, seed: int) -> np.ndarray:
    return mix(h ^ U64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64)))


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or have.size < n:
        size = max(n, GROUP + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets; a null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    kind = np.int64 if large else np.int32
    if offsets is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of table's bytes; no run crosses documents.  Third: word offsets by document."""
    inside = table[buf]
    begin, end = inside.copy(), inside.copy()
    if buf.size:
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < buf.size)]
        begin[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines as a split at newlines gives them: empty ones count, an empty document is one empty line."""
    breaks = np.flatnonzero(buf == 10)
    docs = np.concatenate([np.arange(offsets.size - 1), np.searchsorted(offsets, breaks, "right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    # a document's first line starts it and its last line ends it: sort both by document, then place
    starts = starts[np.lexsort((starts, docs))]
    ends = ends[np.lexsort((ends, np.concatenate([docs[offsets.size - 1 :], docs[: offsets.size - 1]])))]
    return starts, ends, np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=offsets.size - 1))])


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and don't overlap.  fold: as if A-Z were a-z."""
    out = np.empty(starts.size, dtype=np.uint64)
    table = _FOLDED if fold else _TABLE
    at = 0
    while at < starts.size:
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, low + GROUP, "right")))
        high = int(ends[upto - 1])
        size = high - low
        sums = np.empty(size + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(table[buf[low:high]] * powers(size, _BASE), out=sums[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = (sums[e] - sums[s]) * powers(size + 1, _INVERSE)[s]
        at = upto
    return seeded(out, seed)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive values, by doubling; shorter by k - 1."""
    if h.size < k:
        return np.zeros(0, dtype=np.uint64)
    total, done, span, part = None, 0, 1, h
    while True:
        if k & span:
            if total is None:
                total = part
            else:
                n = h.size - (done + span) + 1
                total = mix(total[:n] * U64(_BASE) + part[done : done + n])
            done += span
        if done == k:
            return total[: h.size - k + 1] if k > 1 else total.copy()
        n = part.size - span
        part = mix(part[:n] * U64(0xC2B2AE3D27D4EB4F) + part[span : span + n])
        span *= 2


def windows_at(h: np.ndarray, at: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of the k values from each place of at."""
    out = np.zeros(at.size, dtype=np.uint64)
    for j in range(k):
        out = out * U64(base) + h[at + j]
    return mix(out)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, and so on."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def owners(offsets: np.ndarray) -> np.ndarray:
    """The document of each of offsets[-1] items."""
    return np.repeat(np.arange(offsets.size - 1), np.diff(offsets))


def covered(size: int, starts: np.ndarray, lengths) -> np.ndarray:
    """A mask of size places, true where one of the runs lies."""
    step = np.bincount(starts, minlength=size + 1).astype(np.int32)
    step -= np.bincount(starts + lengths, minlength=size + 1).astype(np.int32)
    return np.cumsum(step[:-1]) > 0
