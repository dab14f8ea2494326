"""Runs a Python function over Arrow batches of a few columns, the only way Python is used in this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from shelfmark.session import spread

#: Most code points of text that go through one pass of a function; a batch of long texts is cut by rows, never within one.
BATCH_CHARS = 4_000_000


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most BATCH_CHARS of ``text``, or single rows beyond that."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > BATCH_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def over_batches(df: DataFrame, text: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """``make()`` runs once per task and gives the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, text):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out

    return spread(df).mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """Texts of a column; null as an empty text."""
    return ["" if v is None else v for v in column.to_pylist()]


#: log2 of the bits of one chunk of a filter.
CHUNK = 19


class Filter:
    """A Bloom filter of a fixed number of bits, whatever is in it: it never misses what was put in."""

    def __init__(self, log_bits: int, chunks: dict[int, bytes]):
        self.log_bits, self.chunks, self._bits = log_bits, chunks, None

    def __getstate__(self):
        return self.log_bits, self.chunks, None

    def __setstate__(self, state):
        self.log_bits, self.chunks, self._bits = state

    @staticmethod
    def probes(hashes: np.ndarray, log_bits: int) -> list[np.ndarray]:
        mask = np.uint64((1 << log_bits) - 1)
        return [(hashes & mask).astype(np.int64), (hashes >> np.uint64(64 - log_bits)).astype(np.int64)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self._bits is None:
            self._bits = np.zeros((1 << (self.log_bits - CHUNK), 1 << (CHUNK - 3)), np.uint8)
            for c, data in self.chunks.items():
                self._bits[c] = np.frombuffer(pa.decompress(data, 1 << (CHUNK - 3), "zstd"), np.uint8)
            self._bits = self._bits.ravel()
        ok = np.ones(len(hashes), bool)
        for at in self.probes(hashes, self.log_bits):
            ok &= (self._bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok


def filter_of(df: DataFrame, log_bits: int) -> Filter:
    """Filter of a table's one bigint column. Tasks send what they have of it, in compressed chunks that are joined in Spark."""

    def put(batches):
        own = np.zeros(1 << (log_bits - 3), np.uint8)
        for batch in batches:
            for at in Filter.probes(batch.column(0).to_numpy().view(np.uint64), log_bits):
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = own.reshape(-1, 1 << (CHUNK - 3))
        used = np.flatnonzero(parts.any(1))
        if len(used):
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array([pa.compress(parts[u].tobytes(), "zstd", asbytes=True) for u in used], pa.binary())], names=["chunk", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << (CHUNK - 3), np.uint8)
        for x in table.column("bits"):
            bits |= np.frombuffer(pa.decompress(x.as_py(), 1 << (CHUNK - 3), "zstd"), np.uint8)
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([pa.compress(bits.tobytes(), "zstd", asbytes=True)], pa.binary())})

    rows = df.mapInArrow(put, "chunk int, bits binary").groupBy("chunk").applyInArrow(unite, "chunk int, bits binary").collect()  # 2^log_bits bits at most
    return Filter(log_bits, {r["chunk"]: bytes(r["bits"]) for r in rows})


__all__ = ["BATCH_CHARS", "Filter", "filter_of", "over_batches", "slices", "strings"]
