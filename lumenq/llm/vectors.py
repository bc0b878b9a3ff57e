"""Vectors as packed rows, and a coarse index of centroids fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.util import spread

SAMPLE = 32_768


def packed_vectors(rows: DataFrame, keys: list[str], vector: str, dims: int) -> DataFrame:
    """keys, vec: the rows whose vector is dims finite numbers, not all zero, as unit float32 bytes.
    Null, shorter, longer, non-finite and all-zero vectors are left out."""
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("vec", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t.filter(pc.fill_null(pc.equal(pc.list_value_length(t["v"]), dims), False)).combine_chunks()
            if t.num_rows == 0:
                continue
            flat = pc.list_flatten(t["v"].combine_chunks())
            x = pc.fill_null(pc.cast(flat, pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
            big = np.abs(x).max(axis=1)
            good = np.isfinite(big) & (big > 0)
            x = x[good] / big[good, None]
            x = (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)
            buf = pa.py_buffer(np.ascontiguousarray(x).tobytes())
            at = pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * (4 * dims)).tobytes())
            vec = pa.Array.from_buffers(pa.binary(), len(x), [None, at, buf])
            t = t.filter(pa.array(good))
            yield from pa.table({**{k: t[k] for k in keys}, "vec": vec}).combine_chunks().to_batches()

    return spread(rows.select(*keys, F.col(vector).alias("v"))).mapInArrow(run, out)


def matrix(vec: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec.to_pylist()), dtype=np.float32).reshape(-1, dims)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit rows; deterministic. An empty one takes the row worst served."""
    rng = np.random.default_rng(seed)
    if k >= len(x):
        return x.copy()
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        s = x @ c.T
        at = s.argmax(axis=1)
        best = s[np.arange(len(x)), at]
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        norm = np.linalg.norm(new, axis=1)
        empty = np.flatnonzero((np.bincount(at, minlength=k) == 0) | (norm == 0))
        if len(empty):
            new[empty] = x[np.argsort(best)[: len(empty)]]
            norm = np.linalg.norm(new, axis=1)
        c = new / norm[:, None]
    return c


def sample_matrix(vectors: DataFrame, dims: int, rows: int, most: int = SAMPLE) -> np.ndarray:
    """At most `most` of the rows vectors, those with the smallest hashes of space and id: the same
    ones whatever the partitioning."""
    part = F.xxhash64("space", "id").alias("h")
    share = min(1.0, 0.97 * most / max(1, rows))
    got = vectors.select(part, "vec").where(F.col("h") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).limit(4 * most).collect()
    got = sorted(((r["h"], bytes(r["vec"])) for r in got))[:most]
    return np.frombuffer(b"".join(v for _, v in got), dtype=np.float32).reshape(-1, dims)


class Coarse:
    """Two levels of centroids. Level 1 has at most `top` cells, level 2 at most `top` below each;
    depth 0 is a single cell."""

    def __init__(self, sample: np.ndarray, rows: int, per_cell: int, top: int = 64):
        self.top = spherical_kmeans(sample, max(1, min(top, len(sample))))
        each = int(max(1, min(top, np.ceil(rows / max(1, len(self.top)) / per_cell))))
        self.sub: list[np.ndarray] = []
        at = (sample @ self.top.T).argmax(axis=1) if len(sample) else np.zeros(0, int)
        for i in range(len(self.top)):
            mine = sample[at == i]
            self.sub.append(spherical_kmeans(mine, each) if len(mine) >= each > 1 else self.top[i : i + 1])
        self.leaf = np.concatenate(self.sub)

    def cells(self, x: np.ndarray, depth: int, margin: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell numbers: the nearest cell of each row, and up to most - 1 others whose
        similarity is within margin of it."""
        if depth == 0:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        c = self.top if depth == 1 else self.leaf
        rows, cells = [], []
        step = max(1, (1 << 20) // len(c))
        for lo in range(0, len(x), step):
            s = x[lo : lo + step] @ c.T
            m = min(most, s.shape[1])
            near = np.argpartition(-s, m - 1, axis=1)[:, :m]
            v = np.take_along_axis(s, near, axis=1)
            r, j = np.nonzero(v >= v.max(axis=1, keepdims=True) - margin)
            rows.append(r + lo)
            cells.append(near[r, j])
        return np.concatenate(rows), np.concatenate(cells).astype(np.int64)
