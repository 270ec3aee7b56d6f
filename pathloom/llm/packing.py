"""Best-fit packing with exact-complement hashing.

Documents become token ids plus an end id 0; pieces longer than a sequence are cut. What is planned is the
histogram of piece lengths, at most `capacity` numbers whatever the corpus: for each length, longest first,
single lengths, pairs and triples whose sum is exactly the gap are looked up by their sums and used up under
the counts still available; what is left goes by best fit, longest first. The plan, lengths of a sequence and
how many such sequences, is then dealt out to the pieces by their rank among pieces of their length.

Null text counts as empty: one piece, the end id. Equal rows are packed one by one; an empty table gives no
piece. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, kept, partitions, small_batches, steps
from .wordbpe import Encoder

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for pieces of the given lengths: (lengths, number of such sequences)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> None:
        """As many sequences of these lengths as the counts allow."""
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(left[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                left[x] -= n * times
            made.append((tuple(sorted(lengths, reverse=True)), times))

    if left[capacity]:
        use(capacity)
    for length in range(capacity - 1, 0, -1):
        if not left[length]:
            continue
        gap = capacity - length
        # lengths over this one are used up, so sums of three reach a gap of at most 3 * length
        if gap > 3 * length:
            break
        use(length, gap)
        low = np.arange(1, gap // 2 + 1)
        for a in low[(left[low] > 0) & (left[gap - low] > 0)].tolist():
            if not left[length]:
                break
            use(length, gap - a, a)
        for x in range(min(gap - 2, length), (gap - 1) // 3, -1):
            if not left[length]:
                break
            if left[x]:
                low = np.arange(max(1, gap - 2 * x), (gap - x) // 2 + 1)
                for a in low[(left[low] > 0) & (left[gap - x - low] > 0)].tolist():
                    use(length, x, gap - x - a, a)
                    if not left[length] or not left[x]:
                        break
    # best fit, longest first: sequences of one make count together, by the room they have
    rooms: dict[int, list[list]] = defaultdict(list)
    open_rooms = np.zeros(capacity + 1, np.int64)

    def add(room: int, lengths: tuple[int, ...], n: int) -> None:
        rooms[room].append([lengths, n])
        open_rooms[room] += n

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(open_rooms[length:])
            if not len(fits):
                each = capacity // length
                if n >= each:
                    add(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    add(capacity - (n % each) * length, (length,) * (n % each), 1)
                break
            room = length + int(fits[0])
            lengths, have = rooms[room][-1]
            times = min(n, have)
            open_rooms[room] -= times
            rooms[room][-1][1] -= times
            if not rooms[room][-1][1]:
                rooms[room].pop()
            add(room - length, (*lengths, length), times)
            n -= times
    made += [(lengths, n) for group in rooms.values() for lengths, n in group]
    return made


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces. tokenizer: its path on the executors."""
    small_batches(docs.sparkSession)

    def encoder() -> Encoder:
        if tokenizer is None:
            import public_tokenizers

            return Encoder(public_tokenizers.path("word_bpe_49k.json"))
        return Encoder(tokenizer)

    def cut_up(batches):
        enc = kept(f"encoder_{tokenizer}", encoder)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            texts = [t or "" for t in texts]
            out: tuple[list, ...] = ([], [], [], [], [])
            ids_of = batch.column(0).to_pylist()
            for lo, hi in steps([len(t) for t in texts], 2 << 20):
                for doc, ids in zip(ids_of[lo:hi], enc.encode(texts[lo:hi])):
                    ids = np.append(ids, 0).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        for column, x in zip(out, (doc, k, at, len(part), zlib.crc32(part.tobytes()))):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs (doc_id, text) with sequence_id and offset, each sequence gapless from 0."""
    spark = docs.sparkSession
    found = cut(pieces(docs, tokenizer, capacity))
    # ranks among the pieces of a length: a length that many pieces share is dealt over slots
    slots = 4 * partitions(spark)
    found = found.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slots)))
    by_slot = cut(found.groupBy("length", "slot").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_slot.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "ids_crc32")
    ranked = found.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "slot"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first"))
    counts = {r["length"]: r["n"] for r in by_slot.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    made = plan(counts, capacity)
    # where the ranks of a length go: from rank, sequence, pieces of that length in it, offset of the first
    entries, used, sequence = [], defaultdict(int), 0
    for lengths, n in made:
        at, i = 0, 0
        while i < len(lengths):
            each = lengths.count(lengths[i])
            entries.append((lengths[i], used[lengths[i]], sequence, each, at))
            used[lengths[i]] += each * n
            at += each * lengths[i]
            i += each
        sequence += n
    entries.sort()
    where = np.array(entries, np.int64).reshape(-1, 5)

    def place(batches):
        keys = (where[:, 0] << 48) + where[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            e = where[np.searchsorted(keys, (length.astype(np.int64) << 48) + rank, "right") - 1]
            k = rank - e[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(e[:, 2] + k // np.maximum(e[:, 3], 1)), pa.array(e[:, 4] + k % np.maximum(e[:, 3], 1) * length)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
