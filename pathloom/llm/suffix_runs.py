"""Suffix-array dedup by a run-length index: removes bytes that earlier documents hold in long matches.

A byte goes if a string of `depth` bytes that covers it also starts in a document of smaller id, as texts were
given. Any such string holds an anchor: an 18-gram whose hash is least among the `depth` - 17 that the string
has, so equal strings have equal anchors. Documents are dealt into blocks; blocks send the anchors they hold,
one entry a block, to fragments of the hash space, which answer with those of several documents. Around these,
blocks cut contexts, all that strings over the anchor can cover; equal contexts of a block go on once, under
the smallest document, and the others are known to match whole. Contexts gather by anchor, and each gathering
is indexed (see runindex): its matching statistics give each string's smallest document. Blocks then mark what
matches and cut it out.

Equal texts are one, kept where the id is smallest. Null text counts as empty. Rows that share an id are no
repeats of each other; rows without an id come last. An empty table gives no row. Columns besides doc_id and
text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Powers, byte_salt, mix, sums
from .common import cut, free, kept, lean, partitions, size_class, small_batches, steps
from .runindex import RunIndex

DEPTH = 50
GRAM = 18
BLOCK_BYTES = 16 << 20
CONTEXTS_A_BUCKET = 16_000
#: Contexts that are indexed at once, about; those of one anchor stay together.
CONTEXTS_A_PIECE = 4_000
TOP = np.uint64(2**64 - 1)
NO_ID = 2**63 - 1


def spread_slots(docs: DataFrame, n: int) -> list[int]:
    """n numbers that hash partitioning puts into n different partitions."""
    spark = docs.sparkSession
    seen: dict[int, int] = {}
    lo = 0
    while len(seen) < n:
        part = spark.range(lo, lo + 16 * n).select(F.col("id").cast("int").alias("id"), F.expr(f"pmod(hash(cast(id as int)), {n})").alias("p"))
        for r in part.groupBy("p").agg(F.min("id").alias("id")).collect():
            seen.setdefault(r["p"], r["id"])
        lo += 16 * n
    return [seen[p] for p in range(n)]


def fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    return ((h >> np.uint64(44)) * np.uint64(fragments)) >> np.uint64(20)


def pack_ids(ids: np.ndarray) -> bytes:
    """40 bits of each id; the others are its fragment."""
    return (ids & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((ids >> np.uint64(32)) & np.uint64(0xFF)).astype("u1").tobytes()


def unpack_ids(fragment: int, raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    low, high = np.frombuffer(raw, "<u4", n).astype(np.uint64), np.frombuffer(raw, "u1", n, 4 * n).astype(np.uint64)
    return (np.uint64(fragment) << np.uint64(40)) | (high << np.uint64(32)) | low


def sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each n in a row."""
    out, width = x, 1
    while 2 * width <= n:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[: len(out) - (n - width)], out[n - width :]) if n > width else out


class Texts:
    """Some texts joined by a byte, their anchors, and hashes of any run of bytes."""

    def __init__(self, texts: list[bytes], fragments: int):
        self.buf = np.frombuffer(b"\x00".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.powers = kept("powers", Powers).reach(len(self.buf))
        self.sums = sums(self.buf, self.powers, byte_salt())
        self.place, self.id, self.text = (np.zeros(0, np.int64),) * 3
        width = DEPTH - GRAM + 1
        if len(self.buf) < DEPTH:
            return
        h = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.powers.down[: len(self.buf) - GRAM + 1])
        at = np.searchsorted(self.begins, np.arange(len(h)), "right") - 1
        h[np.arange(len(h)) + GRAM > (self.begins + self.sizes)[at]] = TOP  # not within a text
        low = sliding(h, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        chosen = (sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h) & (h != TOP) & (self.sizes[at] >= DEPTH)
        self.place = np.flatnonzero(chosen)
        self.text = at[self.place]
        h = h[self.place]
        self.id = (fragment_of(h, fragments) << np.uint64(40)) | ((h >> np.uint64(4)) & np.uint64((1 << 40) - 1))

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.powers.down[a] + (b - a).astype(np.uint64))


def pairs_of(raw: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in raw)]).reshape(-1, 2)


def fresh(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Of a block's rows those that are neither copies of earlier documents nor repeated; and what else came with the copies."""
    fragment = right.column("fragment").to_numpy() if right.num_rows else np.zeros(0, np.int32)
    copies = pairs_of(right.column("ids").filter(pa.array(fragment < 0)).to_pylist()) if right.num_rows else np.zeros((0, 2), np.int64)
    doc, key = left.column("doc_id").to_numpy(), left.column("text_key").to_numpy()
    kind = np.dtype([("d", np.int64), ("k", np.int64)])
    pairs = np.empty(len(doc), kind)
    pairs["d"], pairs["k"] = doc, key
    gone = np.empty(len(copies), kind)
    gone["d"], gone["k"] = copies.T if len(copies) else (0, 0)
    once = np.zeros(len(doc), bool)
    once[np.unique(pairs, return_index=True)[1]] = True
    once &= ~np.isin(pairs, gone) & (left.column("size").to_numpy() >= DEPTH)
    return np.flatnonzero(once), right.filter(pa.array(fragment >= 0)) if right.num_rows else right


def earlier(raw: np.ndarray, h: np.ndarray, doc: np.ndarray, sizes: np.ndarray, starts: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """For each context, cut out of `raw`, which of its strings a smaller document has too, as bits; h: hashes of the contexts."""
    order = np.lexsort((doc, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    lead = order[new]  # one of each equal context, of the smallest document
    by = np.argsort(doc[lead], kind="stable")
    lead = lead[by]
    text_of = np.empty(len(lead), np.int64)
    text_of[by] = np.arange(len(lead))
    n = sizes[lead]
    flat = raw[np.repeat(starts[lead] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    index = RunIndex((flat, n), doc[lead], DEPTH)
    least = index.smallest_owners()
    begin = (index.ends - n)[text_of[group]]
    bits = np.zeros(len(h), np.uint64)
    for k in range(2 * DEPTH - GRAM - DEPTH + 1):
        has = np.flatnonzero(strings > k)
        bits[has] |= (least[begin[has] + k] < doc[has]).astype(np.uint64) << np.uint64(k)
    return bits


def repeats(docs: DataFrame, copies: DataFrame, block_bytes: int = BLOCK_BYTES, want: str = "digest") -> DataFrame:
    """(doc_id, text_key) of texts of DEPTH bytes or more, each once, with n_removed, n_spans and kept (a digest or the bytes).

    docs: doc_id long, text_key long (a hash), text binary. copies: doc_id, text_key of rows whose text an
    earlier document has; they are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size_class(size, block_bytes, partitions(spark))
    fragments = blocks
    slots = F.array(*map(F.lit, spread_slots(docs, blocks)))
    slot_of = F.element_at(slots, F.expr(f"pmod(xxhash64(doc_id), {blocks}) + 1").cast("int"))
    dealt = docs.select("doc_id", "text_key", "text", F.octet_length("text").alias("size"), slot_of.alias("slot")).repartition(blocks, "slot")

    def pack_copies(rows: pa.Table) -> pa.Table:
        pairs = np.stack([rows.column("doc_id").to_numpy(), rows.column("text_key").to_numpy()], 1)
        return pa.Table.from_arrays([pa.array([rows.column("slot")[0].as_py()], pa.int32()), pa.array([-1], pa.int32()), pa.array([np.ascontiguousarray(pairs).tobytes()], pa.binary()), pa.array([len(pairs)], pa.int64())], ["slot", "fragment", "ids", "n"])

    copied = cut(copies.select("doc_id", "text_key", slot_of.alias("slot")).groupBy("slot").applyInArrow(pack_copies, "slot int, fragment int, ids binary, n long"))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        rows = []
        if left.num_rows:
            slot, texts, docs_of = left.column("slot")[0].as_py(), left.column("text"), left.column("doc_id").to_numpy()
            index, _ = fresh(left, right)
            ids, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, hi in steps(left.column("size").to_numpy()[index].tolist()):
                t = Texts([texts[i].as_py() for i in index[lo:hi].tolist()], fragments)
                ids.append(t.id.astype(np.uint64))
                owner.append(docs_of[index[lo:hi]][t.text])
            ids, owner = np.concatenate(ids), np.concatenate(owner)
            order = np.argsort(ids, kind="stable")
            ids, owner = ids[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
            several = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)) if len(first) else np.zeros(0, bool)
            ids = ids[first]
            cuts = np.searchsorted(ids >> np.uint64(40), np.arange(fragments + 1, dtype=np.uint64))
            rows = [(f, slot, pack_ids(ids[a:b]), np.packbits(several[a:b]).tobytes()) for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["fragment", "slot", "ids", "several"])

    sent = dealt.groupBy("slot").cogroup(copied.groupBy("slot")).applyInArrow(send, "fragment int, slot int, ids binary, several binary")

    def answer(rows: pa.Table) -> pa.Table:
        lean()
        f, slots_of = rows.column("fragment")[0].as_py(), rows.column("slot").to_pylist()
        ids = [unpack_ids(f, x) for x in rows.column("ids").to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(i)).astype(bool) for x, i in zip(rows.column("several").to_pylist(), ids)])
        slot = np.repeat(np.array(slots_of, np.int32), [len(x) for x in ids])
        ids = np.concatenate(ids)
        order = np.argsort(ids, kind="stable")
        ids, several, slot = ids[order], several[order], slot[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        n = np.diff(np.append(first, len(ids)))
        shared = np.repeat(np.logical_or.reduceat(several, first) | (n > 1), n)
        by = np.flatnonzero(shared)
        by = by[np.argsort(slot[by], kind="stable")]
        to, at = np.unique(slot[by], return_index=True)
        cuts = np.append(at, len(by))
        return pa.Table.from_arrays([pa.array(to, pa.int32()), pa.array([f] * len(to), pa.int32()), pa.array([pack_ids(ids[by[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()), pa.array(np.diff(cuts), pa.int64())], ["slot", "fragment", "ids", "n"])

    shared = cut(sent.groupBy("fragment").applyInArrow(answer, "slot int, fragment int, ids binary, n long"))
    free(spark)
    buckets = size_class(int(shared.agg(F.sum("n")).first()[0] or 0), CONTEXTS_A_BUCKET, partitions(spark))

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        names = ["bucket", "slot", "docs", "places", "sizes", "anchors", "raw"]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        rows = []
        index, right = fresh(left, right) if left.num_rows else (np.zeros(0, np.int64), right)
        if len(index) and right.num_rows:
            slot = left.column("slot")[0].as_py()
            wanted = np.unique(np.concatenate([unpack_ids(f, x) for f, x in zip(right.column("fragment").to_pylist(), right.column("ids").to_pylist())]))
            docs_of, texts = left.column("doc_id").to_numpy()[index], left.column("text")
            lengths = left.column("size").to_numpy()[index]
            found = []
            for lo, hi in steps(lengths.tolist()):
                t = Texts([texts[i].as_py() for i in index[lo:hi].tolist()], fragments)
                hit = wanted[np.minimum(np.searchsorted(wanted, t.id), len(wanted) - 1)] == t.id if len(t.id) else np.zeros(0, bool)
                place, text, ids = t.place[hit], t.text[hit], t.id[hit]
                begin = np.maximum(place - (DEPTH - GRAM), t.begins[text])
                end = np.minimum(place + DEPTH, t.begins[text] + t.sizes[text])
                whole = np.zeros((len(place), 2 * DEPTH - GRAM), np.uint8)
                if len(place):
                    whole[:] = t.buf[np.minimum(begin[:, None] + np.arange(whole.shape[1]), len(t.buf) - 1)]
                found.append((ids, t.hash(begin, end), docs_of[lo:hi][text], begin - t.begins[text], end - begin, whole, text + lo, (place - begin).astype(np.uint8)))
            ids, h, doc, place, sizes, whole, row, anchor = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((row, doc, h, ids))
            ids, h, doc, place, sizes, whole, anchor = (x[order] for x in (ids, h, doc, place, sizes, whole, anchor))
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])]) if len(ids) else np.zeros(0, bool)
            # others than the smallest document's match whole; its own further places fare as its first
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
            later = doc != doc[first]
            own = ~new & ~later
            if later.any():
                rows.append((-1 - slot, slot, doc[later].tobytes(), place[later].tobytes(), sizes[later].astype("u1").tobytes(), anchor[later].tobytes(), b""))
            go = np.flatnonzero(new | own)
            bucket = ((mix(ids[go]) >> np.uint64(44)) * np.uint64(buckets)) >> np.uint64(20)
            by = np.argsort(bucket, kind="stable")
            go, bucket = go[by], bucket[by]
            cuts = np.append(np.unique(bucket, return_index=True)[1], len(go))
            for a, b in zip(cuts[:-1], cuts[1:]):
                g = go[a:b]
                used = np.arange(whole.shape[1]) < sizes[g][:, None]
                rows.append((int(bucket[a]), slot, doc[g].tobytes(), place[g].tobytes(), sizes[g].astype("u1").tobytes(), anchor[g].tobytes(), whole[g][used].tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    gathered = dealt.groupBy("slot").cogroup(shared.unionByName(copied).groupBy("slot"))
    gathered = gathered.applyInArrow(contexts, "bucket int, slot int, docs binary, places binary, sizes binary, anchors binary, raw binary")

    def match(rows: pa.Table) -> pa.Table:
        """For each document and place, which of the strings from there on go, as bits."""
        lean()
        slot = np.array(rows.column("slot").to_pylist(), np.int32)
        doc, place = (np.concatenate([np.frombuffer(x, np.int64) for x in rows.column(c).to_pylist()]) for c in ("docs", "places"))
        sizes = np.concatenate([np.frombuffer(x, "u1") for x in rows.column("sizes").to_pylist()]).astype(np.int64)
        slot = np.repeat(slot, [len(x) // 8 for x in rows.column("docs").to_pylist()])
        strings = np.maximum(sizes - DEPTH + 1, 0)
        bits = (np.uint64(1) << strings.astype(np.uint64)) - np.uint64(1)
        if rows.column("bucket")[0].as_py() >= 0:
            raw = np.frombuffer(b"".join(rows.column("raw").to_pylist()), np.uint8)
            starts = np.cumsum(sizes) - sizes
            at = starts + np.frombuffer(b"".join(rows.column("anchors").to_pylist()), "u1")
            ends = starts + sizes
            half = (DEPTH - GRAM) // 2
            sides = ((at - half, at + GRAM), (at, at + GRAM + half))
            kinds = (*sides, (at, at + GRAM), (starts, ends))
            hashes = [np.zeros(len(at), np.uint64) for _ in kinds]
            for lo, hi in steps(sizes.tolist()):  # sums over a bounded run of bytes
                first, part = int(starts[lo]), raw[starts[lo] : ends[hi - 1]]
                powers = kept("powers", Powers).reach(len(part))
                run = sums(part, powers, byte_salt())
                for out, (a, b) in zip(hashes, kinds):
                    a, b = np.maximum(a[lo:hi] - first, 0), np.minimum(b[lo:hi] - first, len(part))
                    out[lo:hi] = mix((run[b] - run[a]) * powers.down[a] + (b - a).astype(np.uint64))
            # strings in common hold half the bytes around the anchor, on one side; contexts that share neither go
            alike = np.zeros(len(doc), bool)
            for side, (a, b) in zip(hashes, sides):
                whole = np.flatnonzero((a >= starts) & (b <= ends))
                _, inverse, count = np.unique(side[whole], return_inverse=True, return_counts=True)
                alike[whole] |= count[inverse] > 1
            if not alike.any():
                return pa.Table.from_arrays([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())], ["slot", "docs", "places", "bits"])
            anchor, h = (x[alike] for x in hashes[2:])
            slot, doc, place, sizes, starts, strings = (x[alike] for x in (slot, doc, place, sizes, starts, strings))
            del hashes, kinds, sides, at, ends
            bits = np.zeros(len(h), np.uint64)
            # contexts of different anchors hold nothing in common, so they are indexed piece by piece
            by_anchor = np.argsort(anchor, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(anchor[by_anchor]) > 0) + 1, len(h))
            lo = 0
            while lo < len(h):
                hi = int(ends[max(np.searchsorted(ends, lo + CONTEXTS_A_PIECE, "right") - 1, np.searchsorted(ends, lo, "right"))])
                piece, lo = by_anchor[lo:hi], hi
                bits[piece] = earlier(raw, h[piece], doc[piece], sizes[piece], starts[piece], strings[piece])
        some = np.flatnonzero(bits)
        some = some[np.argsort(slot[some], kind="stable")]
        to, at = np.unique(slot[some], return_index=True)
        cuts = np.append(at, len(some))
        parts = [some[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.Table.from_arrays([pa.array(to, pa.int32()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (doc, place, bits))], ["slot", "docs", "places", "bits"])

    marks = cut(gathered.groupBy("bucket").applyInArrow(match, "slot int, docs binary, places binary, bits binary"))
    free(spark)

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        copies = right.filter(pa.array(np.array(right.column("copies").to_pylist(), bool)))
        index, _ = fresh(left, copies.select(["fragment", "ids"])) if left.num_rows else (np.zeros(0, np.int64), None)
        right = right.filter(pa.array(~np.array(right.column("copies").to_pylist(), bool)))
        docs_of, raw = left.column("doc_id").to_numpy()[index], left.column("text")
        join = lambda c, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in right.column(c).to_pylist())])
        doc, place, bits = join("docs", np.int64), join("places", np.int64), join("bits", np.uint64)
        order = np.argsort(doc, kind="stable")
        doc, place, bits = doc[order], place[order], bits[order]
        lo, hi = np.searchsorted(doc, docs_of), np.searchsorted(doc, docs_of, "right")
        width = DEPTH - GRAM + 1
        out = ([], [], [])
        for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
            text = raw[int(index[i])].as_py()
            removed = spans = 0
            left_over = text
            if b > a:
                turn = np.zeros(len(text) + DEPTH + 1, np.int64)
                begun = ((bits[a:b, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(bool)
                starts = np.unique((place[a:b, None] + np.arange(width))[begun])
                starts = starts[starts + DEPTH <= len(text)]
                turn[starts] += 1
                turn[starts + DEPTH] -= 1
                gone = np.cumsum(turn)[: len(text)] > 0
                removed = int(gone.sum())
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                left_over = np.frombuffer(text, np.uint8)[~gone].tobytes()
                if want == "text":  # whole characters only: a cut one keeps nothing
                    left_over = left_over.decode("utf-8", "ignore").encode()
            for column, x in zip(out, (removed, spans, hashlib.sha256(left_over).hexdigest() if want == "digest" else left_over)):
                column.append(x)
        types = [pa.int64(), pa.int64(), pa.string() if want == "digest" else pa.binary()]
        return pa.Table.from_arrays([pa.array(docs_of), left.column("text_key").take(pa.array(index)), *(pa.array(c, t) for c, t in zip(out, types))], ["doc_id", "text_key", "n_removed", "n_spans", "kept"])

    none = F.lit(None)
    beside = marks.select("slot", F.lit(False).alias("copies"), none.cast("int").alias("fragment"), none.cast("binary").alias("ids"), "docs", "places", "bits")
    beside = beside.unionByName(copied.select("slot", F.lit(True).alias("copies"), "fragment", "ids", *(none.cast("binary").alias(c) for c in ("docs", "places", "bits"))))
    stripped = dealt.groupBy("slot").cogroup(beside.groupBy("slot"))
    return stripped.applyInArrow(strip, "doc_id long, text_key long, n_removed long, n_spans long, kept " + ("string" if want == "digest" else "binary"))


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, raw text, key and size of it, and row, the columns of docs as one), a narrow table of all rows, and the rows whose text an earlier document has.

    Rows are joined with the first of their equals by a digest, without their texts; the join of a text that very
    many rows share is left to Spark to split.
    """
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), raw.alias("raw"), F.xxhash64(raw).alias("key"), F.octet_length(raw).cast("long").alias("n"), F.struct("*").alias("row"))
    short = F.when(F.col("n") < DEPTH, F.sha2("raw", 256)).alias("sha")
    narrow = rows.select(F.col("row")["doc_id"].alias("doc_id"), "id", "key", F.md5("raw").alias("md5"), "n", short)
    first = narrow.groupBy("md5").agg(F.min("id").alias("first"))
    narrow = cut(narrow.join(first, "md5").drop("md5"))
    copies = narrow.where("id > first").select(F.col("id").alias("doc_id"), F.col("key").alias("text_key")).distinct()
    return rows, narrow, copies


def removed(rows: DataFrame, copies: DataFrame, want: str) -> DataFrame:
    done = repeats(rows.select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), F.col("raw").alias("text")), copies, want=want)
    return done.withColumnsRenamed({"doc_id": "d", "text_key": "k"})


def removal_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    rows, narrow, copies = keyed(docs.select("doc_id", "text"))
    done = removed(rows, copies, "digest")
    out = narrow.join(done, (F.col("id") == F.col("d")) & (F.col("key") == F.col("k")), "left")
    copy = (F.col("n") >= DEPTH) & (F.col("id") > F.col("first"))
    return out.select(
        "doc_id", F.col("n").alias("n_bytes"), F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut out of text, columns as given, whatever their names (n_chars, where it is there, follows the text)."""
    rows, _, copies = keyed(docs)
    done = removed(rows, copies, "text").where("n_removed > 0").select("d", "k", "kept")
    whole = copies.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.lit(b"").alias("kept"))
    out = rows.join(done.unionByName(whole), (F.col("id") == F.col("d")) & (F.col("key") == F.col("k")), "left")
    cut_out = F.col("kept").isNotNull() & (F.col("n") >= DEPTH)
    new = F.col("row").withField("text", F.when(cut_out, F.col("kept").cast("string")).otherwise(F.col("row")["text"]))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(cut_out, F.length(F.col("kept").cast("string"))).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType))
    return out.select(new.alias("row")).select("row.*")
