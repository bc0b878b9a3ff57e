"""Mergeable percentiles with a bounded rank error (q-digest).

A value is quantised to one of 2**bits ordered leaves: the leading bits of its order-preserving
64-bit pattern, so the universe is bounded and needs no range given beforehand; a leaf spans a
relative width of 2**-(bits - 12). A digest is a set of nodes of the dyadic tree over the leaves
with counts. Nodes are numbered as in a heap: 1 is the root, 2v and 2v+1 the children of v, leaves
start at 2**bits. Digests of the same universe merge by adding the counts of equal nodes.
`compress` moves counts up into parents while a family of parent and two children holds at most
rank_error * n / bits values, which leaves at most 3 * bits / rank_error nodes and keeps every rank within
rank_error * n, however many digests were merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 20
RANK_ERROR = 0.001


def leaf_of(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The node number of each value's leaf; -0.0 counts as 0.0. NaN must be left out before."""
    v = np.asarray(values, dtype=np.float64) + 0.0
    b = v.view(np.int64)
    ordered = np.where(b < 0, ~b, b | np.int64(-(2**63))).view(np.uint64)
    return (ordered >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits)


def leaf_value(leaf: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The middle of each leaf's interval."""
    at = (np.asarray(leaf, dtype=np.int64) - (1 << bits)).astype(np.uint64) << np.uint64(64 - bits)
    at = at | np.uint64(1 << (63 - bits))
    b = at.view(np.int64)
    raw = np.where(b < 0, b & np.int64(2**63 - 1), ~b)
    return raw.view(np.float64)


def compress(node: np.ndarray, count: np.ndarray, bits: int = BITS, rank_error: float = RANK_ERROR) -> tuple[np.ndarray, np.ndarray]:
    """One digest with distinct nodes, compressed."""
    most = int(rank_error * count.sum() / bits)
    if most < 1 or len(node) <= 3:
        return node, count
    node, count = node.copy(), count.astype(np.int64)
    for depth in range(bits, 0, -1):
        low, high = 1 << depth, 2 << depth
        here = (node >= low) & (node < high)
        if not here.any():
            continue
        parents, inv = np.unique(node[here] >> 1, return_inverse=True)
        kids = np.bincount(inv, weights=count[here], minlength=len(parents)).astype(np.int64)
        # the parents' own counts
        order = np.argsort(node)
        at = np.searchsorted(node[order], parents)
        at = np.minimum(at, len(node) - 1)
        have = node[order][at] == parents
        own = np.where(have, count[order][at], 0)
        move = kids + own <= most
        if not move.any():
            continue
        gone = here.copy()
        gone[here] = move[inv]
        stay = ~gone & ~np.isin(node, parents[move])
        node = np.concatenate([node[stay], parents[move]])
        count = np.concatenate([count[stay], (kids + own)[move]])
    return node, count


def percentiles_of(node: np.ndarray, count: np.ndarray, pcts: list[int], bits: int = BITS) -> np.ndarray:
    """The smallest leaf values with at least pct percent of the counts not above them."""
    depth = np.floor(np.log2(node)).astype(np.int64)
    upper = ((node + 1) << (bits - depth)) - 1
    order = np.lexsort((-depth, upper))
    running = np.cumsum(count[order])
    n = int(running[-1])
    want = np.array([max(1, -(-int(p) * n // 100)) for p in pcts])
    return leaf_value(upper[order][np.searchsorted(running, want)], bits)


def _sketch(keys: list[str], bits: int, rank_error: float):
    """mapInArrow: rows (keys, value) -> (keys, node, n), one compressed digest a flush and group."""
    full = int(bits / rank_error)  # smaller groups are kept as they are by compress

    def flush(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held).group_by([*keys, "node"]).aggregate([("n", "sum")])
        t = pa.table({**{k: t[k] for k in keys}, "node": t["node"], "n": t["n_sum"]}).combine_chunks()
        size = t.group_by(keys).aggregate([("n", "sum")]) if keys else None
        if size is None or pc.any(pc.greater_equal(size["n_sum"], full)).as_py():
            code = np.zeros(t.num_rows, np.int64)
            for k in keys:
                d = t[k].combine_chunks().dictionary_encode(null_encoding="encode")
                code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1]
            node, n = t["node"].to_numpy(), t["n"].to_numpy()
            order = np.argsort(code, kind="stable")
            parts = []
            for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                v, c = compress(node[rows], n[rows], bits, rank_error)
                first = pa.array(np.full(len(v), rows[0]))
                parts.append(pa.table({**{k: t[k].take(first) for k in keys}, "node": pa.array(v), "n": pa.array(c)}))
            t = pa.concat_tables(parts).combine_chunks()
        yield from t.to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            t = pa.Table.from_batches([b])
            v = t["value"].to_numpy()
            held.append(pa.table({**{k: t[k] for k in keys}, "node": pa.array(leaf_of(v, bits)), "n": pa.array(np.ones(len(v), np.int64))}))
            rows += len(v)
            if rows >= 1_000_000:
                yield from flush(held)
                held, rows = [], 0
        if held:
            yield from flush(held)

    return run


def _pack(keys: list[str], bits: int, rank_error: float):
    """applyInArrow: the distinct nodes of one group -> one row (keys, nodes, counts)."""

    def run(t: pa.Table) -> pa.Table:
        node, n = compress(t["node"].to_numpy(), t["n"].to_numpy(), bits, rank_error)
        o = np.argsort(node)
        row = {k: t[k].slice(0, 1).combine_chunks() for k in keys}
        return pa.table({**row, "nodes": pa.array([node[o]], pa.list_(pa.int64())), "counts": pa.array([n[o]], pa.list_(pa.int64()))})

    return run


def digests(rows: DataFrame, keys: list[str], value: str, *, bits: int = BITS, rank_error: float = RANK_ERROR) -> DataFrame:
    """keys, nodes, counts: one digest per group of the measurements in value.

    Null and NaN values are no measurements; a group without any has no row. Null keys form a group.
    Tasks count their own rows by leaf and compress before the shuffle, so a hot group sends a
    bounded number of nodes per task; equal nodes are then added up by key and node, and one task
    compresses a group from at most 2**(bits + 1) distinct nodes, whatever the group's size.
    """
    kept = rows.select(*keys, F.col(value).cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    flat = T.StructType([*[kept.schema[k] for k in keys], T.StructField("node", T.LongType()), T.StructField("n", T.LongType())])
    return merge_nodes(kept.mapInArrow(_sketch(keys, bits, rank_error), flat), keys, bits=bits, rank_error=rank_error)


def merge_nodes(nodes: DataFrame, keys: list[str], *, bits: int = BITS, rank_error: float = RANK_ERROR) -> DataFrame:
    """One digest per group from node rows (keys, node, n): equal nodes add up, then compress."""
    out = T.StructType(
        [*[nodes.schema[k] for k in keys], T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))]
    )
    added = nodes.groupBy(*keys, "node").agg(F.sum("n").alias("n"))
    return added.groupBy(*keys).applyInArrow(_pack(keys, bits, rank_error), out)


def merge(digest_rows: DataFrame, keys: list[str], **how: object) -> DataFrame:
    """Digests merged by node addition to coarser keys."""
    nodes = digest_rows.select(*keys, F.explode(F.arrays_zip("nodes", "counts")).alias("z"))
    return merge_nodes(nodes.select(*keys, F.col("z.nodes").alias("node"), F.col("z.counts").alias("n")), keys, **how)


def percentile_columns(pcts: list[int], bits: int = BITS) -> Column:
    """array<double> of percentiles over the columns nodes and counts."""

    @F.pandas_udf("array<double>")
    def at(nodes, counts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([percentiles_of(np.asarray(a, np.int64), np.asarray(b, np.int64), pcts, bits) for a, b in zip(nodes, counts)])

    return at("nodes", "counts")
