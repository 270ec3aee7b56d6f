"""N-gram Jaccard join by vertical partitioning (after FS-Join, Rong et al. 2017).

A document's set is its distinct word n-grams, as 64-bit hashes; equal sets are one class. The global order of
n-grams is that of their hashes; it is cut into fragments, and what a task sees of the sets is one fragment.

Candidates. A set of n must share, with any set it links with, at least r of the first p n-grams in that order
(the l-prefix rule). Classes send these prefixes to the fragments, an n-gram once a chunk of classes however
many hold it; fragments answer with the n-grams that several classes hold, in the order in which they were sent. A class with fewer than r such links
with nothing; the others drop the r - 1 most frequent ones, which leaves every linked pair an n-gram in common
and empties out passages that many documents share.

Links. In each list the first class is paired with all others, and pairs within the length bound are verified:
each fragment counts the partial overlap of its pairs, and the sums decide. Of lists of up to LONG classes, all
pairs between different components so found are then verified alike. Classes on longer lists are listed anew by
longer prefixes, of which more of the frequent n-grams may be dropped (adaptive prefixes, Wang et al. 2012), so
sets that share no more than a passage part. Lists that are still longer are joined to clusters. What the first
class of a list links with is one component by then, so a large group of copies of one text needs no more; a
cluster of several components is cut into chunks, those of a large component apart, and each pair of chunks that
isn't of one component is a task that counts the partial overlaps of all its pairs at once, fragment by fragment,
and gives a spanning forest of the links. So neither the pairs of a large group are listed nor a link between
components lost.

Texts aren't shuffled: what is wanted of some documents is taken from the table by a filter of their ids.

Null, empty and blank texts have the empty set and link with nothing. Rows that share an id are one document.
An empty table gives no row. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import squeezed, stretched
from .bytewords import mix, word_hashes
from .common import Forest, Sieve, components, cut, free, lean, partitions, size_class, small_batches

FACTORS = np.random.default_rng(31).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Share of a set by which prefixes are longer than one common n-gram asks for.
SLACK = 0.07
#: The same for classes on long lists; below the least share of common n-grams, so linked pairs still meet.
WIDE = 0.5
CHUNK = 400_000
PAIRS_A_GROUP = 100_000
#: Fragments in which overlaps are counted; pairs come in groups of bounded size, so these need not grow.
SEGMENTS = 8
#: Classes of a list beyond which its pairs are not listed.
LONG = 200
#: Classes of a chunk of a cluster of long lists.
BLOCK = 1000


def ngram_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text is one n-gram, a blank one none."""
    h, counts = word_hashes(texts)
    total = len(h) - words + 1
    grams = np.zeros(max(total, 0), np.uint64)
    for j in range(words if total > 0 else 0):
        grams += h[j : j + total] * FACTORS[j]
    grams = mix(grams)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(grams[at : at + n - words + 1]))
        elif n:
            out.append(mix((h[at : at + n] * FACTORS[words : words + n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


class Bounds:
    """Integer bounds for similarity num / den."""

    def __init__(self, num: int, den: int, slack: float = SLACK):
        self.num, self.den, self.slack = num, den, slack

    def least(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def common(self, n: int) -> int:
        return max(1, int(np.ceil(self.slack * n)))

    def prefix(self, n: int) -> int:
        return min(n, n - self.least(n) + self.common(n))

    def needed(self, n: int) -> int:
        return self.common(self.least(n))


def fragment(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(44)) * np.uint64(n)) >> np.uint64(20)


def fragment_cuts(h: np.ndarray, n: int) -> np.ndarray:
    """Where each fragment starts in sorted hashes, and the end."""
    return np.searchsorted(fragment(h, n), np.arange(n + 1, dtype=np.uint64))


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n and two digests of the set."""

    def run(batches):
        lean()
        for batch in batches:
            sets = ngram_sets(batch.column(1).to_pylist(), words)
            n = np.array([len(s) for s in sets], np.int64)
            d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            d2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(d1), pa.array(d2)], ["doc_id", "n", "d1", "d2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long")


def named_texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def passing(batch: pa.RecordBatch, some: Sieve) -> pa.RecordBatch:
    return batch.filter(pa.array(some.passing(batch.column(0).to_numpy(zero_copy_only=False))))


def kept_prefixes(docs: DataFrame, words: int, bounds: Bounds, some: Sieve, fragments: int) -> DataFrame:
    """cls, n, grams that may link it, for those of the documents that pass `some` that have any; cls is the id.

    Chunks of prefixes are shuffled once, and used both to ask the fragments and to choose by their answers. A copy
    of a class that passes by chance does no harm: it links with its class.
    """

    def chunk(batches):
        lean()
        part, k, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            cls, n, raw = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), pa.array([list(cls)], pa.list_(pa.int64())), pa.array([list(n)], pa.list_(pa.int64())), pa.array([b"".join(raw)], pa.binary())], ["chunk", "cls", "n", "grams"])

        for batch in batches:
            batch = passing(batch, some)
            for cls, s in zip(batch.column(0).to_pylist(), ngram_sets(batch.column(1).to_pylist(), words)):
                if len(s):
                    rows.append((cls, len(s), s[: bounds.prefix(len(s))].tobytes()))
                    size += len(rows[-1][2]) // 8
                if size > CHUNK:
                    yield flush()
                    k, rows, size = k + 1, [], 0
        if rows:
            yield flush()

    chunks = named_texts(docs).mapInArrow(chunk, "chunk long, cls array<long>, n array<long>, grams binary").repartition(partitions(docs.sparkSession), "chunk")

    def send(batches):
        lean()
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                ids, n = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                cuts = fragment_cuts(ids, fragments)
                rows = [(f, k, squeezed(ids[a:b], True), squeezed(n[a:b])) for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["fragment", "chunk", "ids", "counts"])

    def answer(t: pa.Table) -> pa.Table:
        """To each chunk, which of the n-grams that it sent several classes hold, and how many."""
        lean()
        ids = [stretched(x, True) for x in t.column("ids").to_pylist()]
        ends = np.cumsum([len(x) for x in ids])
        ids = np.concatenate(ids)
        n = np.concatenate([stretched(x) for x in t.column("counts").to_pylist()])
        order = np.argsort(ids, kind="stable")
        new = np.concatenate([[True], np.diff(ids[order]) > 0])
        total = np.empty_like(n)
        total[order] = np.add.reduceat(n[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        parts = [total[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
        return pa.Table.from_arrays([t.column("chunk"), t.column("fragment"), pa.array([np.packbits(x > 1).tobytes() for x in parts], pa.binary()), pa.array([squeezed(x[x > 1]) for x in parts], pa.binary())], ["chunk", "fragment", "held", "totals"])

    answers = chunks.mapInArrow(send, "fragment int, chunk long, ids binary, counts binary").groupBy("fragment").applyInArrow(answer, "chunk long, fragment int, held binary, totals binary")

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        out = ([], [], [])
        for cls, n, raw in zip(*(left.column(c).to_pylist() for c in ("cls", "n", "grams"))):
            grams, at = np.frombuffer(raw, np.uint64), 0
            ids = np.unique(grams)
            total, cuts = np.ones(len(ids), np.int64), fragment_cuts(ids, fragments)
            for f, held, counts in zip(*(right.column(c).to_pylist() for c in ("fragment", "held", "totals"))):
                several = np.unpackbits(np.frombuffer(held, np.uint8), count=cuts[f + 1] - cuts[f]).astype(bool)
                total[cuts[f] : cuts[f + 1]][several] = stretched(counts)
            df = total[np.searchsorted(ids, grams)]
            for c, size in zip(cls, n):
                end = at + bounds.prefix(size)
                g, d = grams[at:end], df[at:end]
                at = end
                g, d = g[d > 1], d[d > 1]
                left_over = len(g) - (bounds.needed(size) - 1)
                if left_over > 0:
                    rare = np.lexsort((g, d))[:left_over]
                    for column, x in zip(out, (c, size, g[rare].view(np.int64))):
                        column.append(x)
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["cls", "n", "grams"])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(choose, "cls long, n long, grams array<long>")


def picked(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """Segments of the classes in `ids`, and few others, so that the join with them moves no more than it needs."""
    some = Sieve(ids, ids.count())

    def run(batches):
        for batch in batches:
            yield passing(batch, some)

    return segments.mapInArrow(run, "cls long, f int, grams binary")


def verified(pairs: DataFrame, segments: DataFrame, bounds: Bounds) -> DataFrame:
    """The pairs (a, na, b, nb) that link: overlaps counted fragment by fragment and summed per pair.

    Pairs are dealt into groups of bounded size; a group gets the segments of the classes it names.
    """
    groups = size_class(pairs.count(), PAIRS_A_GROUP, 1)
    dealt = pairs.withColumn("g", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(16))), F.lit(groups)).cast("int"))
    needs = dealt.select(F.col("a").alias("cls"), "g").unionByName(dealt.select(F.col("b").alias("cls"), "g")).distinct()
    sent = picked(segments, needs.select("cls").distinct()).join(needs, "cls").select(F.col("g").alias("to_g"), F.col("f").alias("to_f"), "cls", "grams")
    asked = dealt.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)))).select("g", "f", "a", "b")

    def overlap(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        empty = pa.Table.from_arrays([pa.array([], pa.int64())] * 3, ["a", "b", "part"])
        if not left.num_rows or not right.num_rows:
            return empty
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        owner, raw = right.column("cls").to_numpy(), right.column("grams").to_pylist()
        names, first = np.unique(owner, return_index=True)  # rows that share an id bring the same segment
        sets = [np.frombuffer(raw[i], np.uint64) for i in first]
        sizes = np.array([len(s) for s in sets], np.int64)
        starts = np.cumsum(sizes) - sizes
        grams = np.concatenate(sets)
        ranks = np.unique(grams, return_inverse=True)[1].astype(np.int64)
        span = int(ranks.max(initial=0)) + 1
        keys = np.sort(np.repeat(np.arange(len(sets), dtype=np.int64), sizes) * span + ranks)
        ia, ib = np.searchsorted(names, a), np.searchsorted(names, b)
        have = (ia < len(names)) & (ib < len(names))
        have &= (names[np.minimum(ia, len(names) - 1)] == a) & (names[np.minimum(ib, len(names) - 1)] == b)
        a, b, ia, ib = a[have], b[have], ia[have], ib[have]
        part = np.zeros(len(a), np.int64)
        lo = 0
        while lo < len(a):  # a bounded number of n-grams at a time
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[ia[lo : lo + 100_000]]), 2_000_000)))
            n = sizes[ia[lo:hi]]
            ends = np.cumsum(n)
            index = np.repeat(starts[ia[lo:hi]] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            query = np.repeat(ib[lo:hi] * span, n) + ranks[index]
            at = np.minimum(np.searchsorted(keys, query), len(keys) - 1)
            part[lo:hi] = np.bincount(np.repeat(np.arange(len(n)), n), keys[at] == query, len(n))
            lo = hi
        some = part > 0
        return pa.Table.from_arrays([pa.array(a[some]), pa.array(b[some]), pa.array(part[some])], ["a", "b", "part"])

    parts = asked.groupBy("g", "f").cogroup(sent.groupBy("to_g", "to_f")).applyInArrow(overlap, "a long, b long, part long")
    both = parts.groupBy("a", "b").agg(F.sum("part").alias("both")).join(pairs, ["a", "b"])
    return both.where(F.col("both") * bounds.den >= F.lit(bounds.num) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def block_links(members: DataFrame, segments: DataFrame, bounds: Bounds) -> DataFrame:
    """Links (a, b), a spanning forest of each task's, among classes (cls, n, label) of a cluster that differ in label.

    Labels of BLOCK classes or more in a cluster have chunks of their own; the others share some.
    """
    several = members.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("cluster")
    members = members.join(several, "cluster", "left_semi")
    own = members.groupBy("cluster", "label").agg(F.count("*").alias("m")).withColumn("big", F.when(F.col("m") >= BLOCK, F.col("label")))
    sizes = own.groupBy("cluster", "big").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("chunks"))
    before = Window.partitionBy("cluster").orderBy(F.col("big").isNull(), "big").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("first", F.coalesce(F.sum("chunks").over(before), F.lit(0)).cast("int"))
    every = sizes.select("cluster", "big", F.explode(F.sequence("first", F.col("first") + F.col("chunks") - 1)).alias("other")).withColumnRenamed("big", "other_big")
    placed = members.join(own.select("cluster", "label", "big"), ["cluster", "label"])
    same = placed.big.eqNullSafe(sizes.big) & (placed.cluster == sizes.cluster)
    placed = placed.join(sizes, same).select(placed.cluster, placed.cls, placed.n, placed.big, (F.col("first") + F.pmod(F.xxhash64("cls"), F.col("chunks"))).cast("int").alias("chunk"))
    placed = placed.join(every, "cluster").where("big is null or other_big is null or big <> other_big")
    placed = placed.select("cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "cls", "n")

    def block(t: pa.Table) -> pa.Table:
        lean()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        names, first, owner = np.unique(t.column("cls").to_numpy(), return_index=True, return_inverse=True)
        n, side = t.column("n").to_numpy()[first], t.column("chunk").to_numpy()[first]
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        part = t.column("f").to_numpy()
        raw = t.column("grams")
        both = np.zeros((len(left), len(right)), np.float32)
        for f in np.unique(part).tolist():  # partial overlaps of a fragment
            rows = np.flatnonzero(part == f)
            _, once = np.unique(owner[rows], return_index=True)
            rows = rows[once]
            sets = [np.frombuffer(raw[r].as_py(), np.uint64) for r in rows.tolist()]
            who = np.repeat(owner[rows], [len(s) for s in sets])
            grams, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = np.cumsum(count > 1) - 1
            keep = count[column] > 1
            who, column = who[keep], shared[column[keep]]
            order = np.argsort(column, kind="stable")
            who, column = who[order], column[order]
            for lo in range(0, int((count > 1).sum()), 4096):
                s = slice(*np.searchsorted(column, [lo, lo + 4096]))
                held = np.zeros((len(names), 4096), np.float32)
                held[who[s], column[s] - lo] = 1
                both += held[left] @ held[right].T
        forest = Forest(len(names))
        hit = both * bounds.den >= bounds.num * (n[left][:, None] + n[right][None, :] - both)
        if i == j:
            hit &= left[:, None] < right[None, :]
        u, v = np.nonzero(hit)
        forest.add(left[u], right[v])
        u, v = (np.array(z, np.int64) for z in zip(*forest.edges)) if forest.edges else (np.zeros(0, np.int64),) * 2
        return pa.Table.from_arrays([pa.array(names[u]), pa.array(names[v])], ["a", "b"])

    return placed.join(picked(segments, members.select("cls").distinct()), "cls").groupBy("cluster", "i", "j").applyInArrow(block, "a long, b long")


def list_heads(posts: DataFrame) -> DataFrame:
    """The first class and the size of each list of several classes; lists are told apart by round and n-gram."""
    return posts.groupBy("r", "h").agg(F.min(F.struct("cls", "n")).alias("head"), F.count("*").alias("size")).where("size > 1")


def star_pairs(posts: DataFrame, inside: str) -> DataFrame:
    """Pairs (a, na, b, nb) of the first class of each list with the others, within the length bound."""
    stars = posts.join(list_heads(posts), ["r", "h"]).select(F.col("head.cls").alias("a"), F.col("head.n").alias("na"), F.col("cls").alias("b"), F.col("n").alias("nb"))
    return stars.where("a <> b").where(inside).distinct()


def linked(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, a row per row: documents link when den * intersection >= num * union."""
    spark = docs.sparkSession
    small_batches(spark)
    bounds = Bounds(num, den)
    docs = docs.select("doc_id", "text")
    found = cut(profiles(docs, words))
    total = int(found.agg(F.sum("n")).first()[0] or 0)
    classes = found.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("cls"))
    member = found.join(classes, ["d1", "d2", "n"], "left").select("doc_id", "n", F.coalesce("cls", "doc_id").alias("cls"))
    fragments = size_class(total // 4, 2_000_000, partitions(spark))
    names = classes.where("cls is not null").select("cls")
    chosen = cut(kept_prefixes(docs, words, bounds, Sieve(names, found.count()), fragments))
    free(spark)
    posts = chosen.select(F.lit(1).alias("r"), F.explode("grams").alias("h"), "cls", "n")
    inside = f"na * {den} >= nb * {num} and nb * {den} >= na * {num}"
    stars = cut(star_pairs(posts, inside))

    held = Sieve(chosen.select("cls"), chosen.count())

    def cut_up(batches):
        lean()
        for batch in batches:
            batch = passing(batch, held)
            cls, f, grams = [], [], []
            for c, s in zip(batch.column(0).to_pylist(), ngram_sets(batch.column(1).to_pylist(), words)):
                cuts = fragment_cuts(s, SEGMENTS)
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    cls.append(c)
                    f.append(k)
                    grams.append(s[cuts[k] : cuts[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(f, pa.int32()), pa.array(grams, pa.binary())], ["cls", "f", "grams"])

    segments = cut(named_texts(docs).mapInArrow(cut_up, "cls long, f int, grams binary"))
    free(spark)
    links = cut(verified(stars, segments, bounds))
    free(spark)
    far = cut(posts.join(list_heads(posts).where(F.col("size") > LONG), ["r", "h"], "left_semi").select(F.col("cls").alias("doc_id")).distinct())
    if not far.isEmpty():
        wide = Bounds(num, den, WIDE)
        again = cut(kept_prefixes(docs, words, wide, Sieve(far, far.count()), fragments)).select(F.lit(2).alias("r"), F.explode("grams").alias("h"), "cls", "n")
        free(spark)
        more = cut(star_pairs(again, inside).join(stars.select("a", "b"), ["a", "b"], "left_anti"))
        stars = stars.unionByName(more)
        links = cut(links.unionByName(verified(more, segments, bounds)))
        heads = list_heads(again).where(F.col("size") > LONG)
        long = again.join(heads, ["r", "h"]).select(F.col("head.cls").alias("a"), F.col("cls").alias("b")).distinct()
        if not long.isEmpty():
            members = components(long, "a", "b").select(F.col("node").alias("cls"), F.col("component").alias("cluster")).join(chosen.select("cls", "n"), "cls")
            known = components(links, "a", "b").select(F.col("node").alias("cls"), "component")
            members = cut(members.join(known, "cls", "left").select("cluster", "cls", "n", F.coalesce("component", "cls").alias("label")))
            links = cut(links.unionByName(block_links(members, segments, bounds)))
        posts = posts.unionByName(again)
        free(spark)
    first = components(links, "a", "b")
    labelled = posts.join(first.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
    mixed = labelled.groupBy("r", "h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where(F.col("size") <= LONG).where("lo <> hi").select("r", "h")
    open_lists = cut(labelled.join(mixed, ["r", "h"], "left_semi").select("r", "h", "cls", "n", "label"))
    a = open_lists.select("r", "h", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    b = open_lists.select("r", "h", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    rest = a.join(b, ["r", "h"]).where("a < b and la <> lb").where(inside).select("a", "na", "b", "nb").distinct()
    rest = cut(rest.join(stars.select("a", "b"), ["a", "b"], "left_anti"))
    free(spark)
    if not rest.isEmpty():
        links = cut(links.unionByName(verified(rest, segments, bounds)))
        first = components(links, "a", "b")
    out = member.join(first.withColumnRenamed("node", "cls"), "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "cls").alias("component_id"))


def one_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each group of linked ones, columns as given; rows that share an id count as one, those without an id stay.

    Only rows whose ids pass a filter of those that go or come twice are joined and moved; the others stay where they are.
    """
    found = cut(linked(docs, words, num, den).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")))
    unsure = found.where("doc_id <> component_id or rows > 1").select("doc_id")
    some = Sieve(unsure, unsure.count())
    rows = docs.select(F.col("doc_id").alias("id"), F.struct("*").alias("row"))

    def those(pass_: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                ids = batch.column(0)
                hit = some.passing(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == pass_))

        return rows.mapInArrow(run, rows.schema)

    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("id"))
    checked = those(True).join(keep, "id", "left_semi").dropDuplicates(["id"])
    return those(False).select("row.*").unionByName(checked.select("row.*"))
