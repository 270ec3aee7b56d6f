"""What several operators share: tables, cutting lineage, global order, links to components."""

from __future__ import annotations

import gc
import re
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that vectorised Python code works on at once; bounds a worker's memory.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder that the session names.

    Only in local mode, as in tests, a folder is set here where the session names none; a cluster must name one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Lets the cleaner remove shuffle files that nothing refers to any more.

    Python's frames hold theirs in the JVM until they are collected; the cleaner runs beside, so it gets a moment.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows that Arrow hands to Python at once, as single texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def size_class(n: int, per: int, least: int) -> int:
    """How many parts of about `per` units n units need, at least `least`."""
    return max(least, -(-n // per))


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each name -> column of `sums`, the total of the rows before in the global `order`.

    Rows are range-partitioned and kept, so each partition's totals, one row a partition, give the
    partitions' starts; no task holds more than a partition. `order` must be total for stable output.
    """
    n = partitions(df.sparkSession)
    placed = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*(F.sum(c).alias(f"_t_{a}") for a, c in sums.items()))
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_t_{a}").over(before), F.lit(0)).alias(f"_s_{a}") for a in sums))
    out = placed.withColumns({f"_i_{a}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for a, c in sums.items()})
    out = out.join(F.broadcast(starts), "_part")  # one row a partition
    out = out.withColumns({a: F.col(f"_i_{a}") + F.col(f"_s_{a}") for a in sums})
    return out.drop("_part", *(f"_{k}_{a}" for a in sums for k in "is"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` reaches.

    Alternates large-star and small-star rounds (Kiveris et al. 2014); each round is a minimum by node
    (combined before the shuffle) and an equi-join whose skew Spark splits.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct())
        # done when each node hangs on one root and no root hangs on another
        got = new.agg(F.count("*"), F.countDistinct("u")).first()
        e = new
        if got[0] == got[1] and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0:
            roots = new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: Bits of a sieve at most, 8 MB; and bits and marks for each id.
SIEVE_BITS, BITS_EACH, MARKS = 1 << 26, 16, 4


class Sieve:
    """A Bloom filter of ids: all of them pass, and few others, so that rows are dropped before a shuffle and a join after it decides.

    Its size is bounded by SIEVE_BITS whatever the number of ids; beyond some ten million more others pass.
    """

    def __init__(self, ids: DataFrame, count: int):
        import numpy as np
        import pyarrow as pa

        width = min(SIEVE_BITS, 1 << max(12, (BITS_EACH * count).bit_length()))
        self.width = width

        def mark(batches):
            for batch in batches:
                at = np.unique(marks(batch.column(0).to_numpy(zero_copy_only=False), width))
                word = at >> 6
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[: len(word)])
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(bits.view(np.int64))], ["word", "bits"])

        got = ids.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most width / 64 rows
        words = np.zeros(width // 64, np.uint64)
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        self.words = ids.sparkSession.sparkContext.broadcast(words)

    def passing(self, ids):
        """Which of the ids, a numpy array of longs, pass."""
        import numpy as np

        at = marks(ids, self.width).reshape(MARKS, -1)
        return ((self.words.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(0)

    def __getstate__(self):
        return self.width, self.words

    def __setstate__(self, state):
        self.width, self.words = state


def marks(ids, width: int):
    import numpy as np

    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    other = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20) | np.uint64(1)
    return np.concatenate([((h + np.uint64(i) * other) & np.uint64(width - 1)).astype(np.int64) for i in range(MARKS)])


def kept(name: str, make):
    """What make() gives, once per Python worker process; workers serve many tasks."""
    import sys
    import types

    holder = sys.modules.setdefault("_pathloom_worker", types.ModuleType("_pathloom_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def lean() -> None:
    """Keeps a worker's memory near what it uses: large arrays are mapped one by one, and go back to the system when freed."""
    import ctypes

    import pyarrow as pa

    def settle():
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, else it grows with what is freed
        pa.set_memory_pool(pa.system_memory_pool())

    kept("lean", settle)


def steps(sizes, limit: int = STEP_BYTES):
    """Cuts rows of the given sizes into runs (from, to) of about `limit`; a longer row is a run of its own."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


class Forest:
    """Spanning forest of links among n members that come in batches."""

    def __init__(self, n: int):
        import numpy as np

        self.root, self.edges = np.arange(n), []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def add(self, i, j) -> None:
        """Links i[k] - j[k]. Most join what is joined already and fall out by array operations."""
        import numpy as np

        while len(i):
            for ends in (j, i):
                _, first = np.unique(ends, return_index=True)
                for u, v in zip(i[first].tolist(), j[first].tolist()):
                    ru, rv = self.find(u), self.find(v)
                    if ru != rv:
                        self.root[max(ru, rv)] = min(ru, rv)
                        self.edges.append((u, v))
            flat = self.root
            while not np.array_equal(flat, flat[flat]):
                flat = flat[flat]
            self.root = flat.copy()
            apart = flat[i] != flat[j]
            i, j = i[apart], j[apart]
