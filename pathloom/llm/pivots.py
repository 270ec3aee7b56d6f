"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are vectors chosen by a hash of their ids, about the square root of the number of
vectors, `pivots_most` at most. Each vector is described by its `prefix` nearest pivots in order of cosine, and
posted to their inverted lists. Two vectors that share at least `shared` pivots are candidates; they are
compared once, in the list of the first pivot they share, by cosine in double precision. A list is cut into
chunks, and each pair of chunks is a task of its own, so a pivot near a third of all vectors is shared out too;
a task gives link counts and a spanning forest of the links it found, never the pairs.

In a dense group that holds many pivots these are almost equally near, and which are nearest says nothing. So
links of crowded places are found by bounds on angles, without a loss: leaders are pivots of which no two have
a cosine of CROWDED; a vector with such a cosine to a leader is at home with its nearest. A vector that links
with one at home is no farther from that leader than its farthest resident and the threshold's angle, and not
farther beyond the halfway plane to another leader than that angle. It is posted there as a guest, and all
residents are compared with each other and with all guests. Only what is at home nowhere goes by permutations.

Vectors of equal values are one class with a count. Vectors that are null, zero, hold null or non-finite
numbers, or have another length than most, link with nothing, not even their equals. Equal rows are vectors of
their own; an empty table gives no row. Columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, cut, free, small_batches

CHUNK = 2000
#: Rows of a chunk of a leader's list.
CROWD_CHUNK = 4000
#: From this cosine to a leader on, links are found by bounds. Farther out, permutations keep them.
CROWDED = 0.7


def nearest(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first; ties by number."""
    cos = x @ pivots.T
    k = min(prefix, len(pivots))
    top = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(x), 1))
    top.sort(axis=1)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, 1), axis=1, kind="stable"), 1)


def unit(rows: pa.Array, dim: int) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leaders_of(pivots: np.ndarray) -> np.ndarray:
    """Pivots of which no two have a cosine of CROWDED; each other pivot has it to one of them."""
    left, out = pivots, []
    while len(left):
        out.append(left[0])
        left = left[1:][left[1:] @ left[0] < CROWDED]
    return np.array(out)


def join_block(forest: Forest, i_of: np.ndarray, j_of: np.ndarray, hit: np.ndarray) -> None:
    """Adds the links hit[k, l] between i_of[k] and j_of[l]: first one of each row and column, then what is still apart."""
    some = np.flatnonzero(hit.any(1))
    forest.add(i_of[some], j_of[hit[some].argmax(1)])
    some = np.flatnonzero(hit.any(0))
    forest.add(i_of[hit[:, some].argmax(0)], j_of[some])
    i, j = np.nonzero(hit & (forest.root[i_of][:, None] != forest.root[j_of][None, :]))
    forest.add(i_of[i], j_of[j])


def near_vectors(vectors: DataFrame, threshold: float = 0.95, prefix: int = 8, shared: int = 3, pivots_most: int = 4096, pivots: int | None = None) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    small_batches(spark, 5000)
    e = F.col("embedding")
    good = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(good, F.lit(False)), F.transform(e, lambda v: v + F.lit(0.0).cast("float"))).alias("embedding"))
    most = rows.where("embedding is not null").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim = most["d"] if most else 0
    ok = F.col("embedding").isNotNull() & (F.size("embedding") == dim)
    keys = [F.xxhash64("embedding"), F.hash("embedding")]
    rows = rows.select("vec_id", F.when(ok, keys[0]).alias("k1"), F.when(ok, keys[1]).alias("k2"), F.when(ok, F.col("embedding")).alias("embedding"))
    classes = cut(rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")))
    total = classes.count()
    wanted = pivots or min(pivots_most, max(64, math.isqrt(total)))
    taken = classes.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("embedding").collect()  # a bounded sample
    found = None
    if total > 1:
        p = unit(pa.array([list(r["embedding"]) for r in taken], pa.list_(pa.float64())), dim)
        shared = min(shared, len(p))

        lead = leaders_of(p)
        theta = math.acos(max(-1.0, min(1.0, threshold)))
        slack = math.sin(theta) if threshold > 0 else 1.0

        def homes(x):
            """Cosines to the leaders, the nearest leader, and whether the row is at home there."""
            cos = x @ lead.T
            top = cos.argmax(1)
            return cos, top, cos[np.arange(len(x)), top] >= CROWDED

        def farthest(batches):
            for batch in batches:
                cos, top, home = homes(unit(batch.column(0), dim))
                yield pa.RecordBatch.from_arrays([pa.array(top[home].astype(np.int32)), pa.array(cos.max(1)[home])], ["leader", "cos"])

        reach = np.full(len(lead), -np.inf)  # of each leader, the angle within which all guests are
        for r in classes.select("embedding").mapInArrow(farthest, "leader int, cos double").groupBy("leader").agg(F.min("cos").alias("cos")).collect():  # a row a leader
            reach[r["leader"]] = math.acos(min(1.0, r["cos"])) + theta + 1e-6

        def post(batches):
            """Rows of pivots' lists, and of leaders' lists under -1 - leader, there without pivots."""
            for batch in batches:
                x = unit(batch.column(2), dim)
                cos, top, home = homes(x)
                guest = np.arccos(np.clip(cos, -1, 1)) <= reach
                own = np.where(home, top, len(lead))
                guest &= np.arange(len(lead)) < own[:, None]  # residents of two leaders meet at the first
                row, at = np.nonzero(guest)
                apart = np.linalg.norm(lead[top[row]] - lead[at], axis=1)
                ok = cos[row, top[row]] - cos[row, at] <= slack * apart + 1e-6
                row, at = row[ok], at[ok]
                resident, loose = np.flatnonzero(home), np.flatnonzero(~home)
                perm = nearest(x[loose], p, prefix).astype(np.int32) if len(loose) else np.zeros((0, min(prefix, len(p))), np.int32)
                k = perm.shape[1]
                index = pa.array(np.concatenate([np.repeat(loose, k), resident, row]))
                lists = np.concatenate([perm.ravel(), -1 - top[resident], -1 - at]).astype(np.int32)
                inside = np.arange(len(lists)) < len(lists) - len(row)
                ends = np.minimum(np.arange(len(lists) + 1), len(loose) * k) * k
                perms = pa.ListArray.from_arrays(ends.astype(np.int32), np.repeat(perm, k, axis=0).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(inside), *(batch.column(c).take(index) for c in range(3)), perms], ["pivot", "inside", "rep", "n", "embedding", "perm"])

        posted = classes.select("rep", "n", "embedding").mapInArrow(post, "pivot int, inside boolean, rep long, n long, embedding array<float>, perm array<int>")
        per = F.when(F.col("pivot") < 0, CROWD_CHUNK).otherwise(CHUNK)
        lengths = posted.groupBy("pivot").agg(F.count_if("inside").alias("residents"), F.count_if(~F.col("inside")).alias("guests"))
        lengths = lengths.select("pivot", F.ceil(F.col("residents") / per).cast("int").alias("inner"), F.ceil(F.col("guests") / per).cast("int").alias("outer"))
        spread = F.xxhash64("rep")
        chunk = F.when(F.col("inside"), F.pmod(spread, F.col("inner"))).otherwise(F.col("inner") + F.pmod(spread, F.col("outer"))).cast("int")
        chunked = posted.join(F.broadcast(lengths), "pivot").withColumn("chunk", chunk)  # one row a pivot
        met = F.when(F.col("inside"), F.col("inner") + F.col("outer")).otherwise(F.col("inner"))  # guests are not compared with guests
        chunked = chunked.where(met > 0).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
        tasks = chunked.select("pivot", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "rep", "n", "embedding", "perm")

        def compare(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            pivot, a, b = (t.column(c)[0].as_py() for c in ("pivot", "a", "b"))
            rep, n, side = (t.column(c).to_numpy() for c in ("rep", "n", "chunk"))
            x = unit(t.column("embedding").chunk(0) if t.column("embedding").num_chunks else t.column("embedding"), dim)
            left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
            links = np.zeros(len(rep), np.int64)
            forest = Forest(len(rep))
            if pivot < 0:
                for lo in range(0, len(left), 500):
                    i_of = left[lo : lo + 500]
                    j_of = left[lo:] if a == b else right
                    hit = x[i_of] @ x[j_of].T >= threshold
                    if a == b:
                        hit &= i_of[:, None] < j_of[None, :]
                    links[i_of] += (hit @ n[j_of].astype(np.float64)).astype(np.int64)
                    links[j_of] += (n[i_of].astype(np.float64) @ hit).astype(np.int64)
                    join_block(forest, i_of, j_of, hit)
            else:
                perm = np.stack(t.column("perm").to_numpy(zero_copy_only=False))
                held = np.zeros((len(rep), len(p)), np.float32)
                np.put_along_axis(held, perm, 1.0, axis=1)
                lower = np.where(np.arange(len(p)) < pivot, held, 0)  # what they share before this list
                for lo in range(0, len(left), 500):
                    i_of = left[lo : lo + 500]
                    cand = (held[i_of] @ held[right].T >= shared) & (lower[i_of] @ lower[right].T == 0)
                    if a == b:
                        cand &= i_of[:, None] < right[None, :]
                    i, j = np.nonzero(cand)
                    hit = np.zeros(len(i), bool)
                    for at in range(0, len(i), 200_000):
                        s = slice(at, at + 200_000)
                        hit[s] = np.einsum("ij,ij->i", x[i_of[i[s]]], x[right[j[s]]]) >= threshold
                    i, j = i_of[i[hit]], right[j[hit]]
                    links += np.bincount(i, n[j], len(rep)).astype(np.int64) + np.bincount(j, n[i], len(rep)).astype(np.int64)
                    forest.add(i, j)
            some = np.flatnonzero(links)
            u, v = (np.array(z, np.int64) for z in zip(*forest.edges)) if forest.edges else (np.zeros(0, np.int64),) * 2
            return pa.Table.from_arrays([pa.array(np.concatenate([rep[some], rep[u]])), pa.array([None] * len(some) + rep[v].tolist(), pa.int64()), pa.array(np.concatenate([links[some], np.zeros(len(u), np.int64)]))], ["rep", "other", "links"])

        found = cut(tasks.groupBy("pivot", "a", "b").applyInArrow(compare, "rep long, other long, links long"))
        free(spark)
    keyed = rows.drop("embedding").join(classes.select("k1", "k2", "rep", "n"), ["k1", "k2"], "left")
    if found is None:
        return keyed.select("vec_id", F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep", "vec_id").alias("component_id"), (F.coalesce("rep", "vec_id") == F.col("vec_id")).alias("kept"))
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    whole = components(found.where("other is not null"), "rep", "other").withColumnRenamed("node", "rep")
    out = keyed.join(links, "rep", "left").join(whole, "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
