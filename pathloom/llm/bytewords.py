"""64-bit hashes of the words of many texts at once, in numpy.

A word is a run of bytes other than space and 0x09-0x0D, A-Z in lower case; no byte of a longer UTF-8 sequence
is among these, so words by bytes are words by code points.
"""

from __future__ import annotations

import numpy as np

from .common import kept, steps

POWER = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> Powers:
        if len(self.up) < n + 1:
            self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, POWER, np.uint64))])
            self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, pow(POWER, -1, 1 << 64), np.uint64))])
        return self


def byte_salt() -> np.ndarray:
    return np.random.default_rng(2718).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sums(buf: np.ndarray, powers: Powers, salt: np.ndarray) -> np.ndarray:
    """Running sums of salted bytes times powers; with `down` they hash any run of bytes at once."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(salt.take(buf) * powers.up[: len(buf)], out=out[1:])
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    powers, salt = kept("powers", Powers), byte_salt()
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in steps([len(t) for t in texts]):
        joined = b"\n".join(texts[lo:hi])
        buf = LOWER.take(np.frombuffer(joined, np.uint8))
        sizes = np.array([len(t) for t in texts[lo:hi]], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        if not len(buf):
            counts.append(np.zeros(hi - lo, np.int64))
            continue
        space = SPACE.take(buf)
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~space
        turn = np.diff(inside)
        s, e = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        run = sums(buf, powers.reach(len(buf)), salt)
        hashes.append(mix((run[e] - run[s]) * powers.down[s]))
        counts.append(np.diff(np.append(np.searchsorted(s, begins), len(s))))
    return np.concatenate(hashes), np.concatenate(counts)
