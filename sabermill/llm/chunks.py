"""Chunks of documents as compressed rows, and exchanges of key blobs between chunks and buckets.

Statistics over all n-grams or byte windows of a corpus would be billions of shuffled rows. Instead each chunk of some MB of text sorts its own keys and sends one blob per bucket;
a bucket merges its blobs and answers each chunk with one blob in the chunk's key order. Rows are then few, every blob's size is bounded by the chunk's, and a key that
is everywhere costs one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sabermill.llm.kernels import utf8
from sabermill.llm.shared import Scratch


def pack_arrays(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob."""
    sink = pa.BufferOutputStream()
    cols = [pa.array(a) if not isinstance(a, pa.Array) else a for a in arrays]
    n = max(map(len, cols), default=0)
    cols = [pa.concat_arrays([c, pa.nulls(n - len(c), c.type)]) if len(c) < n else c for c in cols]
    batch = pa.RecordBatch.from_arrays(cols, [str(i) for i in range(len(cols))])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=level).compress(sink.getvalue())


def unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as reader:
        return reader.read_next_batch()


def chunked(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, most: int) -> DataFrame:
    """(chunk long, size long, blob): all documents in chunks of about ``most`` bytes of text, written once; null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            blob = pack_arrays(table.column(0), table.column(1))
            return pa.RecordBatch.from_arrays([pa.array([pid << 32 | count]), pa.array([size]), pa.array([blob], pa.binary())], ["chunk", "size", "blob"])

        for batch in batches:
            _, offs = utf8(batch.column(1))
            at = 0
            while at < batch.num_rows:
                to = min(batch.num_rows, max(at + 1, int(np.searchsorted(offs, offs[at] + most - size, "right")) - 1))
                part = pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at).cast(pa.large_binary()).fill_null(b"")], ["id", "text"])
                held.append(part)
                size += int(offs[to] - offs[at])
                at = to
                if size >= most or (at < batch.num_rows and size + int(offs[at + 1] - offs[at]) > most):
                    yield out()
                    count, held, size = count + 1, [], 0
        if held:
            yield out()

    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return scratch.write(cols.mapInArrow(run, "chunk long, size long, blob binary"), "chunks")


def read_chunk(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids, bytes, offsets) of a chunk."""
    batch = unpack(blob)
    buf, offs = utf8(batch.column(1))
    return batch.column(0), buf, offs


def bucket_count(chunks: DataFrame, most: int) -> int:
    """Buckets for keys of all chunks: as many as shuffle partitions, more if that would be over ``most`` bytes of text each."""
    total = chunks.agg(F.sum("size")).first()[0] or 0
    return max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // most), 1)


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range starts in sorted 64-bit keys (``buckets`` + 1 places)."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)
    return np.concatenate([np.searchsorted(keys, edges), [len(keys)]])
