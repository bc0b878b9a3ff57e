"""Keeping cells in size: large ones are split, small ones merged into the nearest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenq.functions.metrics import block
from lumenq.operators import ivf


def plan(index: ivf.Cells, *, most: int = 4096, least: int = 64, operations: int = 8) -> tuple[list[int], list[int]]:
    """The cells to split (largest first) and to merge (smallest first), `operations` at most."""
    if most <= 0 or least < 0 or least * 2 > most or operations <= 0:
        raise ValueError("impossible thresholds")
    rows = sorted((r["n"], r["cell_id"]) for r in index.stats.select("cell_id", "n").collect())  # at most MAX_CELLS
    split = [c for n, c in reversed(rows) if n > most][:operations]
    merge = [c for n, c in rows if n < least][: operations - len(split)]
    return split, merge if len(rows) - len(merge) >= 1 else merge[:-1]


def maintain(index: ivf.Cells, **how: int) -> ivf.Cells:
    """A new index with the planned cells split in two or dissolved. Records of other cells keep
    their cell; nothing is lost or doubled."""
    split, merge = plan(index, **how)
    if not split and not merge:
        return index
    c = {i: v for i, v in enumerate(index.centroids) if i not in set(split) | set(merge)}
    for cell in split:
        x = ivf.sample_rows(index.records.where(F.col("cell_id") == cell), index.id, index.vector, 8192)
        halves = ivf.lloyd(x, 2)
        c[cell] = halves[0]
        c[max([len(index.centroids) - 1, *c]) + 1] = halves[1] if len(halves) > 1 else halves[0] + 1e-9
    new = ivf.build_from(index.records.drop("cell_id"), np.array([c[i] for i in sorted(c)]), index.metric, index.id, index.vector)
    return new


def imbalance(index: ivf.Cells) -> float:
    """The largest cell over the mean one."""
    r = index.stats.agg(F.max("n").alias("m"), F.avg("n").alias("a")).first()
    return float(r["m"]) / float(r["a"])


def drift(index: ivf.Cells) -> np.ndarray:
    """Distances of the centroids to each other, to see cells that lie together."""
    d = block("euclidean", index.centroids, index.centroids)
    np.fill_diagonal(d, np.inf)
    return d.min(1)
