"""Suffix arrays over concatenated byte strings or token numbers, built with numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `symbols` (non-negative integers) in sorted order, by prefix doubling."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    # the first eight symbols of byte text fit one integer, which saves three rounds
    if rank.max() < 255:
        padded = np.concatenate([rank + 1, np.zeros(8, np.int64)])
        packed = np.zeros(n, np.uint64)
        for k in range(8):
            packed = (packed << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
        _, rank = np.unique(packed, return_inverse=True)
        rank = rank.astype(np.int64)
        width = 8
    while True:
        after = np.full(n, -1, np.int64)
        if width < n:
            after[: n - width] = rank[width:]
        key = rank * np.int64(n + 1) + (after + 1)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or width >= n:
            return order
        width *= 2


def words_of_eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number, with zeros after the end."""
    padded = np.append(text, np.zeros(16, np.uint8))
    out = np.zeros(len(text) + 8, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def _shared(text: np.ndarray, at: np.ndarray, patterns: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes the text from `at` and the pattern start..end share at their begin, and whether the text is less there."""
    size = np.zeros(len(at), np.int64)
    less = np.zeros(len(at), bool)
    rows = np.arange(len(at))
    while len(rows):
        done = size[rows]
        left = (ends[rows] - starts[rows] - done).clip(0, 8)
        mask = np.where(left > 0, ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * left.astype(np.uint64)).clip(0, 63), np.uint64(0))
        a = text[np.minimum(at[rows] + done, len(text) - 1)] & mask
        b = patterns[np.minimum(starts[rows] + done, len(patterns) - 1)] & mask
        differ = a ^ b
        # leading bytes that agree
        same = np.full(len(rows), 8)
        for k in range(8):
            same = np.where((same == 8) & ((differ >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0), k, same)
        size[rows] = done + np.minimum(same, left)
        less[rows] = a < b
        rows = rows[(same == 8) & (left == 8)]
    return size, less


def longest_matches(text: np.ndarray, order: np.ndarray, patterns: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all patterns[start:end] at once in the suffix array `order` of `text` (bytes other than zero): (places,
    lengths), each with two rows, of the suffix at or after the pattern's place and of the one before it; one of the two is
    its longest match."""
    text, patterns = words_of_eight(text), words_of_eight(patterns)
    # suffixes by their first eight bytes narrow the search of patterns that have as many
    ordered = text[order]
    full = ends - starts >= 8
    low = np.where(full, np.searchsorted(ordered, patterns[starts], "left"), 0)
    high = np.where(full, np.searchsorted(ordered, patterns[starts], "right"), len(order))
    while (rows := np.flatnonzero(low < high)).size:
        middle = (low[rows] + high[rows]) // 2
        _, less = _shared(text, order[middle].astype(np.int64), patterns, starts[rows], ends[rows])
        low[rows[less]] = middle[less] + 1
        high[rows[~less]] = middle[~less]
    places = np.stack([order[np.minimum(low, len(order) - 1)], order[np.maximum(low - 1, 0)]]).astype(np.int64)
    lengths = np.stack([_shared(text, p, patterns, starts, ends)[0] for p in places])
    return places, lengths


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[i]: symbols that the suffixes order[i-1] and order[i] share at their start (lcp[0] = 0); all pairs at once, symbol by symbol."""
    n = len(symbols)
    lcp = np.zeros(n, np.int64)
    rows = np.arange(1, n)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    while len(rows):
        inside = np.maximum(a, b) < n
        rows, a, b = rows[inside], a[inside], b[inside]
        same = symbols[a] == symbols[b]
        rows, a, b = rows[same], a[same] + 1, b[same] + 1
        lcp[rows] += 1
    return lcp
