"""Compressed codes for approximate scoring, and the leaf modes that use them. A code only decides
which rows are scored; the distances of hits are exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.functions import metrics
from lumenq.functions.metrics import block
from lumenq.operators.ivf import lloyd, routing_code, sample_rows
from lumenq.operators.knn import _queries, check_k, top_k
from lumenq.util import broadcast_if_small

LEAF_MODES = ("flat-scan", "sq-scan", "scalar-bounds", "pq-scan", "srht-pq-scan", "fast-turboquant-mse-scan", "fast-turboquant-scan")
SEED = 0x51A7


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two wide), not normalised."""
    x = x.copy()
    h, n = 1, x.shape[1]
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x


class Srht:
    """Random signs, zero padding to a power of two, and the Hadamard transform."""

    def __init__(self, dims: int, seed: int = SEED):
        self.dims, self.wide = dims, 1 << max(0, dims - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice((-1.0, 1.0), dims)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.wide))
        out[:, : self.dims] = np.asarray(x, float) * self.signs
        return hadamard(out)


class Flat:
    """No code: the first rows by id."""

    def __init__(self, sample: np.ndarray):
        pass

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.zeros((len(x), 1), np.uint8)

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.zeros((len(q), len(codes)))


class ScalarBounds:
    """One byte per dimension: sign * ln(1 + |v|), scaled between the sample's bounds."""

    def __init__(self, sample: np.ndarray):
        y = np.sign(sample) * np.log1p(np.abs(sample))
        self.lo, self.hi = y.min(0), y.max(0)

    def encode(self, x: np.ndarray) -> np.ndarray:
        y = np.sign(x) * np.log1p(np.abs(x))
        wide = self.hi - self.lo
        z = np.where(wide <= 0, 128, np.rint((y - self.lo) / np.where(wide <= 0, 1, wide) * 255))
        return np.clip(z, 0, 255).astype(np.uint8)

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return block("squared-euclidean", self.encode(q), codes)


class ProductQuantizer:
    """A codebook of at most 256 centroids per subspace; queries meet codes through tables of
    squared distances."""

    def __init__(self, sample: np.ndarray, parts: int = 8, rotate: bool = False):
        self.turn = Srht(sample.shape[1]) if rotate else None
        x = self.turn(sample) if rotate else sample
        self.cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        self.books = [lloyd(x[:, a:b], min(256, max(1, len(x) // 4)), 6, SEED + i) for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:]))]

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        x = self.turn(x) if self.turn else np.asarray(x, float)
        return [x[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        return [(p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1)[None, :] for p, c in zip(self._parts(x), self.books)]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([t.argmin(1) for t in self.tables(x)], axis=1).astype(np.uint8)

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return sum(t[:, codes[:, i]] for i, t in enumerate(self.tables(q)))


class Turbo:
    """Rotated scalar codes of `bits` bits per dimension between the sample's bounds; with residual
    a further bit holds the sign of what the code leaves."""

    def __init__(self, sample: np.ndarray, bits: int = 4, residual: bool = False):
        if not 1 <= bits <= 8:
            raise ValueError("bits must be from 1 to 8")
        self.turn, self.bits, self.residual = Srht(sample.shape[1]), bits, residual
        y = self.turn(sample)
        self.lo = np.quantile(y, 0.005, axis=0)
        self.step = np.maximum(np.quantile(y, 0.995, axis=0) - self.lo, 1e-12) / ((1 << bits) - 1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        y = (self.turn(x) - self.lo) / self.step
        code = np.clip(np.rint(y), 0, (1 << self.bits) - 1)
        if not self.residual:
            return code.astype(np.uint8)
        return np.concatenate([code, y > code], axis=1).astype(np.uint8)

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        n = self.turn.wide
        v = self.lo + self.step * codes[:, :n]
        if self.residual:
            v = v + self.step * (codes[:, n:].astype(float) - 0.5) / 2
        t = self.turn(q)
        return (t * t).sum(1)[:, None] - 2 * t @ v.T + (v * v).sum(1)[None, :]


def quantizer(mode: str, sample: np.ndarray):  # noqa: ANN201
    """The quantizer of a leaf mode, fitted on a sample."""
    makers = {
        "flat-scan": Flat,
        "scalar-bounds": ScalarBounds,
        "pq-scan": ProductQuantizer,
        "srht-pq-scan": lambda s: ProductQuantizer(s, rotate=True),
        "fast-turboquant-mse-scan": Turbo,
        "fast-turboquant-scan": lambda s: Turbo(s, 3, True),
    }
    if mode not in makers:
        raise ValueError(f"unknown leaf mode: {mode}")
    return makers[mode](sample)


def encode(vector: Column, q) -> Column:  # noqa: ANN001
    """The code of each vector as binary."""

    @F.pandas_udf(T.BinaryType())
    def run(s):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([c.tobytes() for c in q.encode(np.array(s.tolist(), float))] if len(s) else [], dtype=object)

    return run(vector)


def search_codes(records: DataFrame, queries: DataFrame, k: int, *, mode: str = "srht-pq-scan", metric: str = "euclidean", candidates: int = 200, id: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """Hits by a shortlist of `candidates` rows per query from the codes, then exact distances.

    The quantizer is fitted on at most 65536 records; each task shortlists from its own codes first.
    """
    check_k(k)
    check_k(candidates)
    rows = records.select(F.col(id).alias("id"), F.col(vector).alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
    if mode == "sq-scan":
        q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("__q"))
        both = rows.select("id", "v", routing_code(F.col("v")).alias("c")).crossJoin(broadcast_if_small(q, 10_000))
        w = Window.partitionBy("query_id").orderBy(F.abs(F.col("c") - routing_code(F.col("__q"))), "id")
        short = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= candidates)
        return top_k(short.select("query_id", "id", metrics.distance(metric, F.col("__q"), F.col("v")).alias("distance")), k)
    coder = quantizer(mode, sample_rows(rows, "id", "v"))
    kind = rows.schema["id"].dataType
    hits = None
    for ids, q in _queries(queries, query_id, query_vector):

        def shortlist(frames, q=q):  # noqa: ANN001, ANN202
            import pandas as pd

            for f in frames:
                if not len(f):
                    continue
                x = np.array(f["v"].tolist(), float)
                names = f["id"].to_numpy()
                order = np.argsort(names, kind="stable")
                x, names = x[order], names[order]
                s = coder.scores(q, coder.encode(x))
                m = min(candidates, len(x))
                at = np.argsort(s, axis=1, kind="stable")[:, :m]
                yield pd.DataFrame({"n": np.repeat(np.arange(len(q)), m).astype("int32"), "id": names[at.ravel()], "score": np.take_along_axis(s, at, 1).ravel(), "distance": np.concatenate([block(metric, q[i : i + 1], x[at[i]])[0] for i in range(len(q))])})

        schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.DoubleType()), T.StructField("distance", T.DoubleType())])
        w = Window.partitionBy("n").orderBy("score", "id")
        short = rows.mapInPandas(shortlist, schema).withColumn("r", F.row_number().over(w)).where(F.col("r") <= candidates)
        names = records.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("n", T.IntegerType()), T.StructField("query_id", queries.schema[query_id].dataType)]))
        part = short.join(F.broadcast(names), "n").select("query_id", "id", "distance")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        raise ValueError("no queries")
    return top_k(hits, k)
