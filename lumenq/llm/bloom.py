"""A Bloom filter of 64-bit numbers that tasks make together: what goes to every task when there may
be too many keys to send."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of uint64 numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bloom:
    """16 bits a key up to 64 MB, less beyond."""

    CHUNK = 1 << 16  # bits

    def __init__(self, keys: int, chunks: dict[int, bytes] | None = None):
        self.bits = min(29, max(16, (16 * keys - 1).bit_length() if keys else 0))
        self.words = np.zeros(1 << self.bits >> 3, np.uint8)
        for k, b in (chunks or {}).items():
            self.words[k * self.CHUNK >> 3 : (k + 1) * self.CHUNK >> 3] = np.frombuffer(b, np.uint8)

    def spots(self, h: np.ndarray) -> list[np.ndarray]:
        mask, h = np.uint64((1 << self.bits) - 1), mix(h)
        return [(h >> np.uint64(s) & mask).astype(np.int64) for s in (0, 17, 33)]

    def add(self, h: np.ndarray) -> None:
        for at in self.spots(h):
            np.bitwise_or.at(self.words, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.spots(h):
            out &= (self.words[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def bloom_of(keys: DataFrame) -> Bloom:
    """The filter of column h (distinct): made in parts by the tasks, the parts met by chunk."""
    n = keys.count()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, some = Bloom(n), False
        for batch in batches:
            b.add(batch.column(0).to_numpy().view(np.uint64))
            some |= batch.num_rows > 0
        if some:
            chunks = b.words.reshape(-1, Bloom.CHUNK >> 3)
            at = np.flatnonzero(chunks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([chunks[k].tobytes() for k in at.tolist()], pa.binary())], names=["chunk", "bits"])

    def whole(t: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce(np.stack([np.frombuffer(b, np.uint8) for b in t["bits"].to_pylist()]), axis=0)
        return pa.table({"chunk": t["chunk"].slice(0, 1).combine_chunks(), "bits": pa.array([bits.tobytes()], pa.binary())})

    kind = "chunk bigint, bits binary"
    got = keys.select("h").mapInArrow(part, kind).groupBy("chunk").applyInArrow(whole, kind).collect()  # 64 MB at most
    return Bloom(n, {r["chunk"]: bytes(r["bits"]) for r in got})
