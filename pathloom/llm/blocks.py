"""Rows in blocks, and arrays of numbers as short byte strings, for operators that count over blocks of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import kept, lean, steps


def blocked(docs: DataFrame, limit: int) -> DataFrame:
    """block, rows: the rows of docs in blocks of about `limit` bytes of the binary column `text`, each block one compressed value.

    A block has rows of one partition, in their order; a longer text is a block of its own.
    """

    def run(batches):
        lean()
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            for lo, hi in steps(sizes.tolist(), max(limit // 8, 1)):
                more = int(sizes[lo:hi].sum())
                if held and size + more > limit:
                    yield flush()
                    k, held, size = k + 1, [], 0
                held.append(batch.slice(lo, hi - lo))
                size += more
        if held:
            yield flush()

    return docs.mapInArrow(run, "block long, rows binary")


def unblocked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def squeezed(x: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned 64-bit numbers, `rising` if ascending, byte by byte, as upper bytes are alike."""
    x = np.diff(x, prepend=np.uint64(0)) if rising else x.astype(np.uint64)
    return kept("press", lambda: zstandard.ZstdCompressor(level=1)).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T))


def stretched(raw: bytes, rising: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(kept("unpress", zstandard.ZstdDecompressor).decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(x, dtype=np.uint64) if rising else x
