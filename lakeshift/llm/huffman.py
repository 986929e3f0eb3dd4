"""Canonical, length-limited Huffman code for token ids, in whole-array steps."""

from __future__ import annotations

import numpy as np

#: Ids between two bit-offset checkpoints; a block is decoded at all its checkpoints side by side.
LANE = 64


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge) for positive counts."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need codes of more than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    level, is_symbol = weights, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_symbol.append(by < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(is_symbol):
        symbols = int(flags[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The code of ids ``ids`` (ascending) with ``lengths``; the lengths alone fix it."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.bits = int(lengths.max(initial=1))
        order = np.lexsort((ids, lengths))
        first = (np.uint64(1) << (self.bits - lengths[order]).astype(np.uint64)).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(first)[:-1]]).astype(np.uint64) if len(ids) else first
        size = int(ids.max(initial=0)) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids[order]] = at >> (self.bits - lengths[order]).astype(np.uint64)
        self.length[ids] = lengths
        # the decoding table: the next self.bits bits give id and length
        self.table = np.zeros(1 << self.bits, np.int64)
        filled = np.repeat((ids[order].astype(np.int64) << 5) | lengths[order], first.astype(np.int64))
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code runs of ids, each from a byte boundary on.

        ``(bytes, bytes per run, bit offsets within its run of every LANE-th id, such offsets per run)``.
        """
        length = self.length[ids]
        end = np.cumsum(length)
        start = end - length
        last = np.cumsum(sizes)
        first = last - sizes
        filled = sizes > 0
        bits = np.zeros(len(sizes), np.int64)
        bits[filled] = end[last[filled] - 1] - start[first[filled]]
        n_bytes = (bits + 7) >> 3
        base = np.zeros(len(sizes), np.int64)
        base[filled] = start[first[filled]]
        within = start - np.repeat(base, sizes)
        start = within + np.repeat((np.cumsum(n_bytes) - n_bytes) * 8, sizes)
        v = self.code[ids] << (64 - length - (start & 31)).astype(np.uint64)
        word = start >> 5
        total = int(n_bytes.sum())
        out = np.zeros(total // 4 + 3, np.uint64)
        if len(ids):
            runs = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[runs]] = np.bitwise_or.reduceat(v >> np.uint64(32), runs)
            out[word[runs] + 1] |= np.bitwise_or.reduceat(v & np.uint64(0xFFFFFFFF), runs)
        place = np.arange(len(ids)) - np.repeat(first, sizes)
        return np.frombuffer(out.astype(">u4").tobytes(), np.uint8)[:total], n_bytes, within[place % LANE == 0].astype("<u4"), -(-sizes // LANE)

    def decode(self, payload: bytes, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of runs of ``sizes`` ids; ``offsets`` are their checkpoints, in bits from the start of ``payload``."""
        d = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
        window = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
        at = offsets.astype(np.int64)
        out = np.zeros((len(at), LANE), np.uint32)
        mask, last = (1 << self.bits) - 1, len(window) - 1
        for j in range(LANE):
            got = self.table[(window[np.minimum(at >> 3, last)] >> (32 - self.bits - (at & 7))) & mask]
            out[:, j] = got >> 5
            at += got & 31
        # the last lane of a run is not full
        lanes = -(-sizes // LANE)
        full = np.full(len(at), LANE)
        ends = np.cumsum(lanes)
        full[ends[lanes > 0] - 1] = (sizes - (lanes - 1) * LANE)[lanes > 0]
        return out[np.arange(LANE) < full[:, None]]
