"""A run-length compressed Burrows-Wheeler index of many short texts, for matches of a fixed length.

The matrix rows are ordered by the first `depth` symbols, ties by place. Texts are laid in order of owner, so the
first row of the rows that share `depth` symbols, an interval, is of their smallest owner. Kept are the runs of the
transform, that owner for each interval, and where the intervals for depth - 1 begin. Texts are streamed against it
from right to left: a step drops the last symbol of the match (the interval for depth - 1) and adds the one to the
left by the rank of that symbol in the runs, so the matching statistics, cut at `depth`, come out place by place
without the suffix array.

Besides the runs two numbers are kept for each row: where its interval for depth - 1 begins, and the owner sampled
for its interval. So a step looks up instead of searching, which halves the time, at 12 bytes a row; an index is of
one gathering of contexts, whose rows are bounded, and isn't kept. What is compressed by runs is the transform.
"""

from __future__ import annotations

import numpy as np


def in_order(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by key, below `top`, ties by place; and where in that order the key changes."""
    n = len(key)
    bits = max(n.bit_length(), 1)
    if top.bit_length() + bits <= 63:  # keys sort faster with their places in them than beside them
        both = np.sort((key << bits) | np.arange(n))
        rows, key = both & ((1 << bits) - 1), both >> bits
    else:
        rows = np.argsort(key, kind="stable")
        key = key[rows]
    return rows, np.concatenate([[True], key[1:] != key[:-1]])[:n]


def order_by(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by the first `depth` symbols, and where these, and the first depth - 1, change. t: symbols below 512, 0 after the end."""
    n = len(t)

    def ranked(key: np.ndarray, top: int) -> np.ndarray:
        rows, new = in_order(key, top)
        out = np.empty(n, np.int64)
        out[rows] = np.cumsum(new) - 1
        return out

    def longer(rank: np.ndarray, by: int) -> np.ndarray:
        key = rank * (n + 1)
        key[: max(n - by, 0)] += rank[by:] + 1  # past the end all is alike
        return ranked(key, (n + 1) ** 2)

    key = np.zeros(n, np.int64)
    width = min(4, depth - 1)
    for k in range(width):
        key <<= 9
        key[: max(n - k, 0)] |= t[k:]
    shorter = ranked(key, 1 << (9 * width))
    while width < depth - 1:
        by = min(width, depth - 1 - width)
        shorter, width = longer(shorter, by), width + by
    full = shorter * 512
    full[: max(n - depth + 1, 0)] += t[depth - 1 :]
    rows, change = in_order(full, 512 * (n + 1))
    cut = shorter[rows]
    return rows, change, np.concatenate([[True], cut[1:] != cut[:-1]])[:n]


class RunIndex:
    def __init__(self, texts: list[bytes] | tuple[np.ndarray, np.ndarray], owners: np.ndarray, depth: int):
        """owners: ascending, one a text. texts: or their joined bytes and their sizes."""
        if isinstance(texts, list):
            texts = np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int64)
        raw, self.sizes = texts
        self.depth = depth
        self.ends = np.cumsum(self.sizes + 1) - 1  # places of the separators
        t = np.zeros(len(raw) + len(self.sizes), np.int64)
        inside = np.ones(len(t), bool)
        inside[self.ends] = False
        t[inside] = raw.astype(np.int64) + 1
        self.t = t
        rows, full, shorter = order_by(t, depth)
        n = len(t)
        bwt = t[rows - 1]  # the first place follows the last separator
        starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]])) if n else np.zeros(0, np.int64)
        symbol, length = bwt[starts], np.diff(np.append(starts, n))
        by = np.argsort(symbol, kind="stable")
        self.run_key = symbol[by] * (n + 1) + starts[by]
        self.run_start, self.run_length, self.run_symbol = starts[by], length[by], symbol[by]
        before = np.cumsum(self.run_length) - self.run_length
        first = np.searchsorted(self.run_symbol, np.arange(258))
        self.before = before - before[np.minimum(first[self.run_symbol], max(len(before) - 1, 0))] if len(before) else before
        counts = np.bincount(t, minlength=258)
        self.less = np.cumsum(counts) - counts
        self.n = n
        self.intervals = np.flatnonzero(full)
        self.shorter = np.flatnonzero(shorter)
        # samples at the first row of each interval: the text it comes from
        text = np.searchsorted(self.ends, rows[self.intervals])
        self.owner = np.asarray(owners)[text] if n else np.zeros(0, np.int64)
        row_of = np.empty(n, np.int64)
        row_of[rows] = np.arange(n)
        self.end_rows = self.intervals[np.searchsorted(self.intervals, row_of[self.ends], "right") - 1]
        # the intervals by row, so that a step looks up instead of searching
        self.shorter_start = np.repeat(self.shorter, np.diff(np.append(self.shorter, n))).astype(np.int32)
        self.row_owner = np.repeat(self.owner, np.diff(np.append(self.intervals, n)))

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the symbol stands in the transform before the row."""
        at = np.searchsorted(self.run_key, symbol * (self.n + 1) + row) - 1
        there = np.maximum(at, 0)
        mine = (at >= 0) & (self.run_symbol[there] == symbol)
        return np.where(mine, self.before[there] + np.minimum(row - self.run_start[there], self.run_length[there]), 0)

    def smallest_owners(self) -> np.ndarray:
        """For each place of the joined texts, separators and all, the smallest owner of the `depth` symbols from it."""
        out = np.zeros(self.n, np.int64)
        row, place = self.end_rows.copy(), self.ends.copy()
        left = self.sizes.copy()
        live = np.flatnonzero(left > 0)
        while len(live):
            place[live] -= 1
            left[live] -= 1
            c = self.t[place[live]]
            row[live] = self.less[c] + self.rank(c, self.shorter_start[row[live]].astype(np.int64))
            out[place[live]] = self.row_owner[row[live]]
            live = live[left[live] > 0]
        return out
