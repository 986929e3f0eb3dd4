"""Words and word shingles of a batch of texts as 64-bit hashes, in whole-array steps.

A word's hash is a polynomial over its UTF-8 bytes modulo 2**64, taken from one running sum
over the batch, then mixed; a shingle's hash combines its words' hashes.  Two different
words or shingles share a hash with a probability of about 2**-64.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}

WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII that is neither letter nor digit.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct values in order; for integers, sorting is several times faster than a hash table."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separator: np.ndarray = WHITE_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes of all words, first word of each text, end of each text's words)``.

    ``data`` holds the UTF-8 bytes of the texts, text ``i`` at ``starts[i]:ends[i]``; A-Z are folded.
    """
    n = len(data)
    if n == 0:
        zero = np.zeros(len(starts), np.int64)
        return np.zeros(0, np.uint64), zero, zero
    word = ~separator[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[starts[starts < n]] = False
    first = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[ends[ends > starts] - 1] = False
    last = np.flatnonzero(word & ~after) + 1
    up, down = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return h, np.searchsorted(first, starts), np.searchsorted(first, ends)


def shingles(h: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, hash)`` of every run of ``k`` words; of a text with fewer words, the whole run."""
    size = b - a
    of = np.repeat(np.arange(len(a)), size)
    starts = np.flatnonzero(np.arange(len(h)) + k <= np.repeat(b, size))
    s = np.zeros(len(starts), np.uint64)
    for j in range(k):
        s = s * np.uint64(0xD1342543DE82EF95) + h[starts + j]
    short = np.flatnonzero((size > 0) & (size < k))
    tail = np.zeros(len(short), np.uint64)
    for i, t in enumerate(short):
        v = int(size[t])
        for x in h[a[t] : b[t]].tolist():
            v = (v * 0xD1342543DE82EF95 + x) & (2**64 - 1)
        tail[i] = v
    texts, hashes = np.concatenate([of[starts], short]), mix(np.concatenate([s, tail]))
    if len(short):
        order = np.argsort(texts, kind="stable")
        texts, hashes = texts[order], hashes[order]
    return texts, hashes


def batches(texts: pa.Array, most_bytes: int = 1 << 19):
    """Cut a string array into runs of about ``most_bytes``: ``(first text, data, starts, ends)``; null is empty.

    Words and shingles of a run take some 40 times its bytes while they are made."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1)
        j = min(j, len(texts))
        o = offsets[i : j + 1] - offsets[i]
        yield i, data[offsets[i] : offsets[j]], o[:-1], o[1:]
        i = j


#: Modules in which the operators that tokenize keep what they learned for a worker's next task.
KEPT = ("_lakeshift_worker", "_lakeshift_aligners")


def trim() -> None:
    """Give free memory back to the system: of arrays that this and earlier tasks are done with, Arrow's pool keeps
    some for later ones, and the C library what lies below others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def hand_back() -> None:
    """Give memory back to the system that this worker does not need now.

    That is what other operators keep for their next task, which build it again then, and free memory.
    """
    for name in KEPT:
        sys.modules.pop(name, None)
    trim()


def shingle_sets(texts: pa.Array, k: int, separator: np.ndarray = WHITE_SPACE):
    """Per text, its number and the sorted distinct hashes of its shingles."""
    hand_back()
    for first, data, starts, ends in batches(texts):
        of, hashes = shingles(*words(data, starts, ends, separator), k)
        cuts = np.searchsorted(of, np.arange(len(starts) + 1))
        for i in range(len(starts)):
            yield first + i, distinct(hashes[cuts[i] : cuts[i + 1]])
    hand_back()
