"""Encodes many texts at once with a tokenizers file of the lower-case word-end BPE kind, in numpy.

`Encoder(path).encode(texts)` gives what Tokenizer.from_file(path).encode_batch(texts,
add_special_tokens=False) gives. Texts of code points below U+0180 take the vectorised way: words are cut
by character class, each distinct word is merged once, and one merge of every word is made at a time. Any
other text (wider scripts, control characters, spelled-out special tokens) goes to the library itself.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

LIMIT = 0x180
SPACE, LETTER, NUMBER, OTHER, ODD = 0, 1, 2, 3, 4
#: Odd, for hashes of words that are sums of values times powers.
POWER = 0x9E3779B97F4A7C15
NONE = np.int32(2**31 - 1)


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for U+0100 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    #: Distinct words whose ids are kept between calls.
    KEEP = 1_500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self._merges(np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int64))
        kinds = {"L": LETTER, "N": NUMBER}
        self.kind, self.low = np.zeros(LIMIT, np.uint8), np.arange(LIMIT, dtype=np.uint16)
        for c in range(LIMIT):
            ch = chr(c)
            space = c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0)
            if len(ch.lower()) != 1 or (unicodedata.category(ch) == "Cc" and not space):
                self.kind[c] = ODD
            else:
                self.kind[c] = SPACE if space else kinds.get(unicodedata.category(ch)[0], OTHER)
                self.low[c] = ord(ch.lower())
        chars = byte_chars()
        self.first = np.full((LIMIT, 2), -1, np.int32)  # symbols of a code point
        self.last = np.full((LIMIT, 2), -1, np.int32)  # where it ends a word
        for c in range(LIMIT):
            raw = chr(c).encode()
            self.first[c, : len(raw)] = [vocab[chars[b]] for b in raw]
            self.last[c, : len(raw)] = [vocab[chars[b]] for b in raw[:-1]] + [vocab[chars[raw[-1]] + end]]
        rng = np.random.default_rng(12345)
        self.salt = rng.integers(1, 2**63, LIMIT, dtype=np.uint64) | np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.key, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def _merges(self, merges: np.ndarray) -> None:
        """An open-addressing table of the merge pairs: key -> rank, result."""
        self.bits = int(len(merges)).bit_length() + 2
        size = 1 << self.bits
        self.table_key, self.table_rank, self.result = np.full(size + 64, -1, np.int64), np.full(size + 64, NONE, np.int32), merges[:, 2].astype(np.int32)
        self.probes = 1
        keys = (merges[:, 0] << 17) | merges[:, 1]
        seen = {}
        for rank, key in enumerate(keys.tolist()):
            if key in seen:
                continue
            seen[key] = rank
            at = int(self._slot(np.array([key]))[0])
            k = 0
            while self.table_key[at + k] >= 0:
                k += 1
            self.table_key[at + k], self.table_rank[at + k] = key, rank
            self.probes = max(self.probes, k + 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 17) | b
        at = self._slot(key)
        found = self.table_key[at]
        out = np.where(found == key, self.table_rank[at], NONE)
        left = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(1, self.probes):
            if not len(left):
                break
            at[left] += 1
            found = self.table_key[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.table_rank[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def _merge_words(self, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sym: (words, width) symbols, -1 after the end. Merges the first pair of lowest rank of each word until none is left."""
        words, width = sym.shape
        if width < 2:
            return sym, n
        rank = np.where(sym[:, 1:] >= 0, self._rank(np.maximum(sym[:, :-1], 0).ravel(), np.maximum(sym[:, 1:], 0).ravel()).reshape(words, width - 1), NONE)
        done_sym, done_n = sym.copy(), n.copy()
        live = np.arange(words)
        while len(live):
            at = rank.argmin(1)
            rows = np.arange(len(live))
            best = rank[rows, at]
            go = best < NONE
            if not go.all():
                stop = ~go
                done_sym[live[stop], : sym.shape[1]], done_n[live[stop]] = sym[stop], n[stop]
                live, sym, rank, n, at, best = live[go], sym[go], rank[go], n[go], at[go], best[go]
                rows = np.arange(len(live))
                if not len(live):
                    break
            cols = np.arange(sym.shape[1] - 1)
            merged = np.take_along_axis(sym, cols + (cols > at[:, None]), 1)
            merged[rows, at] = self.result[best]
            ranks = np.take_along_axis(rank, np.minimum(cols[:-1] + (cols[:-1] > at[:, None] - 1) * 1, rank.shape[1] - 1), 1) if len(cols) > 1 else np.zeros((len(rows), 0), np.int32)
            sym, n = merged, n - 1
            width = sym.shape[1]
            # the pairs to the left and right of the merged symbol are new
            for k in (at - 1, at):
                ok = np.flatnonzero((k >= 0) & (k + 1 < n))
                if len(ok):
                    ranks[ok, k[ok]] = self._rank(sym[ok, k[ok]], sym[ok, k[ok] + 1])
                gone = np.flatnonzero((k >= 0) & (k + 1 >= n) & (k < width - 1))
                if len(gone):
                    ranks[gone, k[gone]] = NONE
            rank = ranks
            if not rank.shape[1]:
                done_sym[live, :width], done_n[live] = sym, n
                break
        return done_sym, done_n

    def _new(self, cps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of words, given as runs of code points, by groups of like length: (index, ids, counts)."""
        out = []
        order = np.argsort(sizes, kind="stable")
        by = sizes[order]
        lo = 0
        while lo < len(order):
            size = int(by[lo])
            hi = int(np.searchsorted(by, size, "right"))
            hi = min(hi, lo + max(1, 4_000_000 // size))
            index = order[lo:hi]
            text = cps[starts[index][:, None] + np.arange(size)]
            sym = self.first[text]
            sym[:, -1] = self.last[text[:, -1]]
            flat = sym.reshape(len(index), 2 * size)
            have = flat >= 0
            n = have.sum(1).astype(np.int64)
            if n.max() != size or n.min() != size:
                keep = np.argsort(~have, axis=1, kind="stable")[:, : int(n.max())]
                flat = np.take_along_axis(flat, keep, 1)
            else:
                flat = flat[:, ::2].copy()
            if size > 400:  # one merge at a time over a long run is slow; the library's queue is not
                for i, row in zip(index, text):
                    word = "".join(map(chr, row))
                    ids = np.array([x.id for x in self.slow.model.tokenize("".join(byte_chars()[b] for b in word.encode()))], np.int32)
                    out.append((np.array([i]), ids[None, :], np.array([len(ids)])))
            else:
                ids, n = self._merge_words(flat, n)
                out.append((index, ids, n))
            lo = hi
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, uint32."""
        out: list[np.ndarray | None] = [None] * len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        cps = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(sizes + 1) - sizes - 1
        if not len(cps):
            return [np.zeros(0, np.uint32) for _ in texts]
        bad = np.flatnonzero(cps >= LIMIT) if int(cps.max()) >= LIMIT else np.zeros(0, np.int64)
        if not len(bad):
            cps = cps.astype(np.uint16)
            kind = self.kind.take(cps)
            if int(kind.max()) == ODD:
                bad = np.flatnonzero(kind == ODD)
        spelled = [i for i, t in enumerate(texts) if "<|" in t and any(s in t for s in self.special)]
        if len(bad) or spelled:
            slow = np.zeros(len(texts), bool)
            slow[np.searchsorted(begin, bad, "right") - 1] = True
            slow[spelled] = True
            index = np.flatnonzero(slow)
            for i, e in zip(index, self.slow.encode_batch([texts[i] for i in index], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32)
            rest = np.flatnonzero(~slow)
            if len(rest):
                for i, ids in zip(rest, self.encode([texts[i] for i in rest])):
                    out[i] = ids
            return out
        cps = self.low.take(cps)
        prev = np.empty_like(kind)
        prev[0], prev[1:] = SPACE, kind[:-1]
        start = (kind != SPACE) & ((kind != prev) | (kind == NUMBER))
        long = np.zeros(len(cps) + 4, np.uint8)
        quote = np.flatnonzero((cps == ord("'")) & (prev != OTHER))
        if len(quote):
            padded = np.concatenate([cps, np.full(4, 10, np.uint32)])
            one, two = padded[quote + 1], padded[quote + 2]
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for at, n in ((quote[single], 2), (quote[double & ~single], 3)):
                long[at] = n
                start[at + 1] = False
                after = at + n
                after = after[after < len(cps)]
                start[after] = kind[after] != SPACE
        s = np.flatnonzero(start)
        if not len(s):
            return [np.zeros(0, np.uint32) for _ in texts]
        # a word ends where the next one starts or a space follows
        stop = np.zeros(len(cps) + 1, bool)
        stop[:-1] = (kind == SPACE) | start
        stop[-1] = True
        ends = np.flatnonzero(stop)
        e = ends[np.searchsorted(ends, s, "right")]
        uniq, first, inverse = np.unique(self._hash(cps, s, e), return_index=True, return_inverse=True)
        at, n = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64)
        place = np.searchsorted(self.key, uniq)
        hit = np.zeros(len(uniq), bool)
        if len(self.key):
            near = np.minimum(place, len(self.key) - 1)
            hit = self.key[near] == uniq
            at[hit], n[hit] = self.at[near[hit]], self.n[near[hit]]
        store = [self.store]
        base = len(self.store)
        miss = np.flatnonzero(~hit)
        if len(miss):
            f = first[miss]
            for index, ids, counts in self._new(cps, s[f], e[f] - s[f]):
                flat = ids[np.arange(ids.shape[1]) < counts[:, None]].astype(np.uint32)
                at[miss[index]], n[miss[index]] = base + np.cumsum(counts) - counts, counts
                store.append(flat)
                base += len(flat)
        ids = np.concatenate(store) if len(store) > 1 else self.store
        if len(miss) and len(self.key) < self.KEEP:
            self.store = ids
            self.key, self.at, self.n = (np.insert(old, place[miss], new[miss]) for old, new in ((self.key, uniq), (self.at, at), (self.n, n)))
        count = n[inverse]
        total = np.cumsum(count)
        flat = ids[np.repeat(at[inverse] - (total - count), count) + np.arange(total[-1])]
        word_doc = np.searchsorted(s, begin)  # first word of each text
        cuts = np.concatenate([[0], total])[np.append(word_doc, len(s))]
        return [flat[cuts[i] : cuts[i + 1]] for i in range(len(texts))]

    def _hash(self, cps: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hash of each run of code points: its share of a running sum of values times powers, scaled back to its start."""
        if len(self.powers) < len(cps) + 1:
            size = 2 * len(cps) + 1
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, POWER, np.uint64))])
            self.inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, pow(POWER, -1, 1 << 64), np.uint64))])
        sums = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum(self.salt.take(cps) * self.powers[: len(cps)], out=sums[1:])
        out = (sums[e] - sums[s]) * self.inverses[s]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))
