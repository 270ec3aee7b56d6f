"""Language-model scoring by a weighted backoff automaton.

The model is of n-grams up to `order` words, each smoothed towards the next shorter: P(w|hs) =
(c(hsw) + mu P(w|s)) / (c(hs) + mu), where s is h's rest without its first word, down to P(w) =
(c(w) + 0.1) / (N + 0.1 (V + 1)). As an automaton, each seen sequence of less than `order` words is a state. It
has an arc for each seen n-gram that continues it, weighted with the n-gram's smoothed probability, to the
longest state that the n-gram ends in; and a failure arc, weighted with mu / (c(h) + mu), to the state without
its first word; the root has arcs for all words. A text is walked once from left to right: the state is carried
from word to word, and where it has no arc for a word, failure arcs are followed and their weights added until a
state has one. All texts of a block walk at once, place by place of the failure chain.

Counts are gathered from all training texts and no task or broadcast holds them all. Documents are put into
blocks of bounded size. Each block sends what it counted, one row a block and fragment of the hash space, so a
word that is everywhere costs one entry a block; a fragment adds up and answers each block, in the order of what
it sent, with the totals that differ from the block's own and with its share of N and V. Each block then builds
the part of the automaton that its texts can reach, and walks them. Words and n-grams are told apart by 64 bits.

Null and empty texts have one token, the end. Texts without an id train and are not held out. Equal rows score
alike and are all counted. A text longer than a block is a block of its own. An empty table gives no row. Columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, squeezed, stretched, unblocked
from .bytewords import mix, word_hashes
from .common import lean, partitions, size_class, small_batches, steps
from .linear import fold

BLOCK_BYTES = 12 << 20
#: Bytes of text whose entries a fragment of the hash space gathers, about.
FRAGMENT_BYTES = 16 << 20
ORDER = 3
END, START = np.uint64(0x0E4D), np.uint64(0x57A7)
STEP = np.uint64(0x9E3779B97F4A7C15)


def ngrams(texts: list[bytes], order: int):
    """First the tokens of each text, and each token's place in its text; then, for each m up to `order`, the ids of the m-grams that end at each token.

    A text is its words and an end, and begins after a start. The m-gram at place p exists where p >= m - 2.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts + 1) - 1
    word = np.full(len(hashes) + len(texts), END, np.uint64)
    is_word = np.ones(len(word), bool)
    is_word[ends] = False
    word[is_word] = hashes
    del hashes, is_word
    place = np.arange(len(word), dtype=np.int32) - np.repeat(ends - counts, counts + 1).astype(np.int32)
    yield counts + 1, place
    yield word
    gram = word
    for m in range(1, order):
        before = np.roll(gram, 1)
        if m == 1:
            before[place == 0] = START
        gram = mix(before * STEP + word)
        yield gram


def counted(ids: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, and how often they occur in training texts."""
    distinct = np.sort(ids)
    distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])[: len(distinct)]]
    n = np.zeros(len(distinct), np.uint64)
    seen, times = np.unique(ids[train], return_counts=True)
    n[np.searchsorted(distinct, seen)] = times
    return distinct, n


def fragment_cuts(ids: np.ndarray, fragments: int) -> np.ndarray:
    """Where each fragment of the hash space starts in ascending ids, and the end."""
    return np.searchsorted(((ids >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32), np.arange(fragments + 1, dtype=np.uint64))


class Block:
    """The texts of a block; `orders` gives, for each m, the distinct m-grams, how often they train, and the m-gram that ends at each place, 0 where there is none."""

    def __init__(self, rows: bytes, order: int):
        lean()
        self.rows, self.order = unblocked(rows), order
        self.grams = ngrams(self.rows.column("text").to_pylist(), order)
        self.sizes, self.place = next(self.grams)
        self.trains = np.repeat(~self.rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool), self.sizes)

    def orders(self):
        for m, gram in enumerate(self.grams):
            real = self.place >= m - 1
            ids, n = counted(gram[real], self.trains[real])
            yield ids, n, np.where(real, gram, np.uint64(0))


class Automaton:
    """What texts of a block can reach: counts[m]: totals of the m-grams; at[m]: the (m + 1)-gram that ends at each place, -1 for none."""

    def __init__(self, counts: list[np.ndarray], at: list[np.ndarray], place: np.ndarray, starts: int, n: int, v: int, mu: float):
        self.c = [np.where(a >= 0, c[a], 0).astype(np.float64) if len(c) else np.zeros(len(a)) for c, a in zip(counts, at)]
        p = (self.c[0] + 0.1) / (n + 0.1 * (v + 1))
        self.arcs, self.fails, self.states = [np.log10(p)], [], []  # the root's arcs
        for m in range(1, len(counts)):
            # the state of m words that is before each place: how often it was seen
            h = np.where(place == 0, starts if m == 1 else 0, np.roll(self.c[m - 1], 1))
            p = (self.c[m] + mu * p) / (h + mu)
            self.arcs.append(np.log10(p))
            self.fails.append(np.log10(mu / (h + mu)))
            self.states.append(h > 0)

    def walk(self) -> np.ndarray:
        """The log-probability of each token from the state that the walk is in there."""
        level = np.zeros(len(self.arcs[0]), np.int8)  # words of the state that is carried to each place
        for there in self.states:
            level += there
        out = np.zeros(len(level))
        for m in range(len(self.arcs) - 1, 0, -1):
            here = level == m
            arc = here & (self.c[m] > 0)
            out[arc] += self.arcs[m][arc]
            level[arc] = -1
            fail = here & ~arc
            out[fail] += self.fails[m - 1][fail]
            level[fail] = m - 1
        root = level == 0
        out[root] += self.arcs[0][root]
        return out


def score(docs: DataFrame, parts: int = 10, held: int = 0, mu: float = 25.0, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = size_class(size, block_bytes, partitions(spark))
    fragments = size_class(size, FRAGMENT_BYTES, partitions(spark))
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), held_out)
    blocks = blocked(rows, block_bytes).repartition(n_parts, "block")

    def send(batches):
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sent = [[] for _ in range(fragments)]
                for ids, n, _ in Block(raw, order).orders():
                    at = fragment_cuts(ids, fragments)
                    for f, row in enumerate(sent):
                        row += [squeezed(ids[at[f] : at[f + 1]], True), squeezed(n[at[f] : at[f + 1]])]
                    del ids, n
                for lo in range(0, fragments, 64):
                    some = sent[lo : lo + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(some)), pa.int32()), pa.array([block] * len(some)), pa.array(some, pa.list_(pa.binary()))], ["fragment", "block", "sent"])

    def answer(t: pa.Table) -> pa.Table:
        lean()
        sent, n, v = t.column("sent").to_pylist(), 0, 0
        replies = [[] for _ in sent]
        for m in range(order):
            ids = [stretched(s[2 * m], True) for s in sent]
            own = np.concatenate([stretched(s[2 * m + 1]) for s in sent])
            ends = np.cumsum([len(x) for x in ids])
            order_of = np.argsort(ids := np.concatenate(ids), kind="stable")
            new = np.concatenate([[True], np.diff(ids[order_of]) > 0])[: len(ids)]
            sums = np.add.reduceat(own[order_of], np.flatnonzero(new)) if len(ids) else own
            total = np.empty_like(own)
            total[order_of] = sums[np.cumsum(new) - 1] if len(ids) else own
            if m == 0:
                n, v = int(sums.sum()), int((sums > 0).sum())
            for reply, lo, hi in zip(replies, np.concatenate([[0], ends[:-1]]), ends):
                differs = total[lo:hi] != own[lo:hi]
                reply += [np.packbits(differs).tobytes(), squeezed(total[lo:hi][differs])]
        k = len(sent)
        return pa.Table.from_arrays([t.column("block"), t.column("fragment"), pa.array([n] * k), pa.array([v] * k), pa.array(replies, pa.list_(pa.binary()))], ["block", "fragment", "n", "v", "reply"])

    sent = blocks.mapInArrow(send, "fragment int, block long, sent array<binary>").repartition(fragments, "fragment")
    answers = sent.groupBy("fragment").applyInArrow(answer, "block long, fragment int, n long, v long, reply array<binary>")

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left.column("rows")[0].as_py(), order)
        n, v = (int(right.column(c).to_numpy().sum()) for c in ("n", "v"))  # every fragment answers every block
        replies, f = right.column("reply").to_pylist(), right.column("fragment").to_numpy()
        counts, at = [], []
        for m, (ids, total, gram) in enumerate(b.orders()):
            cuts = fragment_cuts(ids, fragments)
            for k, reply in zip(f.tolist(), replies):
                differs = np.unpackbits(np.frombuffer(reply[2 * m], np.uint8), count=cuts[k + 1] - cuts[k]).astype(bool)
                total[cuts[k] : cuts[k + 1]][differs] = stretched(reply[2 * m + 1])
            if m == 0:
                starts = int(total[np.searchsorted(ids, END)])  # as many texts start as end
            counts.append(total)
            at.append(np.where(b.place >= m - 1, np.searchsorted(ids, gram), -1).astype(np.int32))
            del ids, gram
        ends = np.concatenate([[0], np.cumsum(b.sizes)])
        base, total, known = (np.zeros(len(b.sizes)) for _ in range(3))
        for lo, hi in steps(b.sizes.tolist(), 200_000):
            here = slice(ends[lo], ends[hi])
            model = Automaton(counts, [a[here] for a in at], b.place[here], starts, n, v, mu)
            for out, x in ((base, model.arcs[0]), (total, model.walk()), (known, model.c[0] > 0)):
                out[lo:hi] = np.add.reduceat(x, ends[lo:hi] - ends[lo], dtype=np.float64)
        columns = [b.rows.column("doc_id"), b.rows.column("held_out"), b.sizes.astype(np.int64), known.astype(np.int64), np.full(len(known), n, np.int64), base, total]
        return pa.Table.from_arrays([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    walked = blocks.groupBy("block").cogroup(answers.repartition(n_parts, "block").groupBy("block"))
    return walked.applyInArrow(walk, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
