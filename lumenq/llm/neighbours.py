"""The k most similar vectors of every vector, by randomly rotated one-bit codes (RaBitQ).

Vectors are placed in the cells of a coarse index. Within a cell each vector's residual to the
cell's mean is rotated and reduced to one bit per dimension, with its length and its code's inner
product as correction scalars; a query is rotated and reduced to four bits per dimension. Inner products are estimated from the packed bits by AND and popcount,
each with an error bound; only pairs whose upper bound reaches the k-th best lower bound are
computed exactly. A cell over max_cell rows is worked on in tiles of blocks, so no task holds more
than two blocks and every pair of the cell is still seen.

What the cells find gives every vector a lower bound of its k-th best cosine. A second, exact pass
follows in spaces of more than one cell: rows are grouped by their nearest centroid and the angle to
it, and a row meets every group that by the triangle inequality may hold a pair as good as its bound,
so a dense cluster cut into many cells is still compared with itself as a whole. Groups are written as
blocks to the shared folder, where the tasks read those they need one at a time: no row is sent to
the blocks it meets, and no task holds more than its own rows and one block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.vectors import Coarse, matrix, sample_matrix
from lumenq.util import broadcast_if_small, hadoop_path, materialize, scratch_path

EPSILON = 3.0  # standard deviations of the estimate that its bound spans
CHUNK = 256


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix over dims padded to a multiple of 64; its first dims rows."""
    wide = -(-dims // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dims].astype(np.float32)


class Codes:
    """One-bit codes of the rows x against the centre c."""

    def __init__(self, x: np.ndarray, c: np.ndarray, rot: np.ndarray):
        wide = rot.shape[1]
        res = x - c
        self.r = np.sqrt((res * res).sum(axis=1))
        self.y = (res / np.maximum(self.r, 1e-12)[:, None]) @ rot
        self.bits = np.packbits(self.y > 0, axis=1, bitorder="little").view(np.uint64)
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(np.float32)
        align = np.maximum(np.abs(self.y).sum(axis=1) / np.sqrt(wide), 1e-6)
        self.align = np.where(self.r > 1e-9, align, 1).astype(np.float32)
        self.bound = (EPSILON * np.sqrt(np.maximum(1 - self.align**2, 0)) / self.align / np.sqrt(wide - 1)).astype(np.float32)
        self.shift = (x @ c).astype(np.float32)  # x.q = c.x + c.q - c.c + res.res_q
        self.wide = wide

    def planes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        y = self.y[rows]
        lo = y.min(axis=1)
        step = np.maximum(y.max(axis=1) - lo, 1e-12) / 15
        q = np.rint((y - lo[:, None]) / step[:, None]).astype(np.uint8)
        planes = np.stack([np.packbits((q >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(4)])
        return planes, lo.astype(np.float32), step.astype(np.float32), y.sum(axis=1).astype(np.float32)


def estimates(stored: Codes, query: Codes, rows: np.ndarray, cc: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of query rows to all stored rows, and their error bounds."""
    planes, lo, step, total = query.planes(rows)
    acc = np.zeros((len(rows), len(stored.r)), np.int16)
    for w in range(stored.bits.shape[1]):
        code = stored.bits[:, w]
        for j in range(4):
            acc += np.bitwise_count(planes[j][:, w, None] & code[None, :]).astype(np.int16) << j
    est = acc.astype(np.float32)
    est *= step[:, None]
    est += lo[:, None] * stored.ones[None, :]
    est *= 2
    est -= total[:, None]
    est *= (stored.r / stored.align / np.sqrt(stored.wide)).astype(np.float32)[None, :]
    rq = query.r[rows].astype(np.float32)
    est *= rq[:, None]
    est += stored.shift[None, :]
    est += (query.shift[rows] - np.float32(cc))[:, None]
    bound = rq[:, None] * (stored.r * stored.bound).astype(np.float32)[None, :]
    bound += (rq * step)[:, None] * stored.r.astype(np.float32)[None, :] * np.float32(0.5 * EPSILON / np.sqrt(3))
    return est, bound


def top_pairs(x: np.ndarray, q: np.ndarray | None, rank: np.ndarray, k: int, least: float, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, stored row, cosine): for each row of q the k best rows of x and those that tie
    with the k-th, of cosine least or more; of many that tie those of the k best ids, by rank of the
    stored rows' ids. Without q, x against itself, a row not with itself."""
    own = q is None
    if own:
        q = x
    c = x.mean(axis=0)
    stored = Codes(x, c, rot)
    query = stored if own else Codes(q, c, rot)
    cc = float(c @ c)
    # queries that are alike go together, so a chunk needs few columns
    anchors = q[np.random.default_rng(5).permutation(len(q))[: max(1, int(np.sqrt(len(q))))]]
    order = np.argsort((q @ anchors.T).argmax(axis=1), kind="stable")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(order), CHUNK):
        rows = order[lo : lo + CHUNK]
        est, bound = estimates(stored, query, rows, cc)
        if own:
            est[np.arange(len(rows)), rows] = -9
        low = est - bound
        tau = np.full(len(rows), least, np.float32)
        if len(x) > k:
            tau = np.maximum(tau, np.partition(low, len(x) - k, axis=1)[:, len(x) - k])
        est += bound
        mask = est >= tau[:, None]
        cols = np.flatnonzero(mask.any(axis=0))
        if not len(cols):
            continue
        exact = np.where(mask[:, cols], q[rows] @ x[cols].T, np.float32(-9))
        floor = np.full(len(rows), least - 1e-6, np.float32)
        if len(cols) > k:
            floor = np.maximum(floor, np.partition(exact, len(cols) - k, axis=1)[:, len(cols) - k] - np.float32(2e-6))
        i, j = np.nonzero(exact >= floor[:, None])
        i, j = rows[i], cols[j]
        s = _cosines(q, i, x, j)
        good = np.flatnonzero(s >= least)
        if len(good) > 4 * k * len(rows):  # many that tie
            good = good[_best_each(i[good], rank[j[good]], s[good], k)]
        found.append((i[good], j[good], s[good]))
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*found))  # type: ignore[return-value]


def _keep_k(i: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each i: by similarity to 7 places (what float32 vectors hold), then id."""
    order = np.lexsort((ids, -np.round(s, 7), i))
    first = np.r_[True, np.diff(i[order]) != 0] if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return order[np.arange(len(order)) - start < k]


OUT = "space string, id string, neighbour string, cosine double"


def _tile(dims: int, k: int, least: float):
    rot = rotation(dims)

    def run(t: pa.Table) -> pa.Table:
        space = t["space"][0].as_py()
        once = list({(i, v): n for n, (i, v) in enumerate(zip(t["id"].to_pylist(), t["vec"].to_pylist()))}.values())  # repeated rows
        t = t.take(pa.array(once))
        ids = np.array(t["id"].to_pylist(), dtype=object)
        rank = np.unique(ids, return_inverse=True)[1]
        x = matrix(t["vec"], dims)
        side = t["side"].to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(b):
            one = top_pairs(x[a], x[b], rank[a], k + 1, least, rot)
            two = top_pairs(x[b], x[a], rank[b], k + 1, least, rot)
            i = np.concatenate([b[one[0]], a[two[0]]])
            j = np.concatenate([a[one[1]], b[two[1]]])
            s = np.concatenate([one[2], two[2]])
        else:
            i, j, s = top_pairs(x, None, rank, k + 1, least, rot)
        good = ids[i] != ids[j]
        i, j, s = i[good], j[good], s[good]
        if len(i):
            pick = _keep_k(i, rank[j], s, k)  # ranks are in the order of ids
            i, j, s = i[pick], j[pick], s[pick]
        return pa.table(
            {
                "space": pa.array([space] * len(i), pa.string()),
                "id": pa.array(ids[i].tolist(), pa.string()),
                "neighbour": pa.array(ids[j].tolist(), pa.string()),
                "cosine": pa.array(s, pa.float64()),
            }
        )

    return run


def _place(index: Coarse, dims: int, margin: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            x = matrix(t["vec"], dims)
            depth = t["depth"].to_numpy()
            for d in np.unique(depth):
                at = np.flatnonzero(depth == d)
                r, c = index.cells(x[at], int(d), margin, most)
                rows = t.take(pa.array(at[r]))
                yield from pa.table({"space": rows["space"], "cell": pa.array(c), "id": rows["id"], "vec": rows["vec"]}).combine_chunks().to_batches()

    return run


SLACK = np.float32(2e-6)  # of a float32 cosine
TURN = 2e-3  # of an angle computed from one
EDGES = np.deg2rad([20.0, 30.0, 40.0, 50.0, 60.0])  # a cell's rows are grouped by the angle to its centroid
OUTER = 3  # groups from here on hold rows near no centroid; they have blocks of their own
CELLS_AT_ONCE = 1 << 20  # angles of rows to centroids in memory
PAIRS_AT_ONCE = 1 << 14  # pairs whose vectors are in memory in float64
UNIT = 4  # blocks that one task searches for at most
HELD = 4  # times k pairs a row are held before they are reduced


def _homes(index: Coarse):
    """mapInArrow: (space, id, vec, depth, parts) with the nearest cell, the angle to it and its shell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = index.top.shape[1]
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            x, depth = matrix(t["vec"], dims), t["depth"].to_numpy()
            cell, angle = np.zeros(len(x), np.int64), np.zeros(len(x))
            for d in np.unique(depth):
                at = np.flatnonzero(depth == d)
                c = index.top if d == 1 else index.leaf
                step = max(1, CELLS_AT_ONCE // len(c))
                for lo in range(0, len(at), step):
                    rows = at[lo : lo + step]
                    s = x[rows] @ c.T
                    cell[rows] = s.argmax(axis=1)
                    angle[rows] = np.arccos(np.clip(s.max(axis=1), -1, 1))
            t = t.append_column("cell", pa.array(cell)).append_column("angle", pa.array(angle))
            yield from t.append_column("shell", pa.array(np.searchsorted(EDGES, angle).astype(np.int32))).combine_chunks().to_batches()

    return run


def _store(folder: str, dims: int, most: int):
    """mapInArrow over rows in the order of space, side, cell and shell: writes them as blocks of at most
    `most` rows of one space and side, a file each. Out: where each row is, without its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pfs

        def stored(t: pa.Table) -> pa.RecordBatch:
            name = uuid.uuid4().int >> 66
            ids = np.array(t["id"].to_pylist(), dtype=object)
            rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
            vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), t.num_rows, [None, pa.py_buffer(b"".join(t["vec"].to_pylist()))])
            block = pa.table({"id": t["id"], "vec": vec, "rank": rank}).combine_chunks()
            fs, path = pfs.FileSystem.from_uri(folder)
            with fs.open_output_stream(f"{path}/{name}") as f, pa.ipc.new_file(f, block.schema) as w:
                w.write_table(block)
            n = t.num_rows
            cols = {c: t[c] for c in ("space", "depth", "outer", "cell", "shell", "angle", "id")}
            cols |= {"block": np.full(n, name, np.int64), "pos": np.arange(n, dtype=np.int32), "same": np.full(n, np.bincount(rank).max(), np.int32)}
            return pa.table(cols).combine_chunks().to_batches()[0]

        held: list[pa.Table] = []
        key, rows = None, 0
        for b in batches:
            t = pa.Table.from_batches([b])
            keys = list(zip(t["space"].to_pylist(), t["outer"].to_pylist()))
            lo = 0
            while lo < t.num_rows:
                if rows and (keys[lo] != key or rows == most):
                    yield stored(pa.concat_tables(held))
                    held, rows = [], 0
                key, hi = keys[lo], lo
                while hi < len(keys) and keys[hi] == key and rows + hi - lo < most:
                    hi += 1
                held.append(t.slice(lo, hi - lo))
                rows, lo = rows + hi - lo, hi
        if rows:
            yield stored(pa.concat_tables(held))

    return run


STORED = "space string, depth int, outer boolean, cell bigint, shell int, angle double, id string, block bigint, pos int, same int"


class Blocks:
    """The blocks of one space and the groups of each, by block."""

    def __init__(self, groups: list):
        groups = sorted(groups, key=lambda g: (not g["outer"], g["block"], g["first"]))
        self.depth = groups[0]["depth"]
        self.cell, self.first, self.n = (np.array([g[c] for g in groups], np.int32) for c in ("cell", "first", "n"))
        self.lo, self.hi = (np.array([g[c] for g in groups], np.float32) for c in ("lo", "hi"))
        at = np.flatnonzero(np.r_[True, [a["block"] != b["block"] for a, b in zip(groups, groups[1:])]])
        self.names, self.same = [groups[i]["block"] for i in at], [groups[i]["same"] for i in at]
        self.rows = np.add.reduceat(self.n, at)
        self.of = [slice(a, b) for a, b in zip(at, np.r_[at[1:], len(groups)])]

    def reach(self, x: np.ndarray, far: np.ndarray, block: int, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(group, rows): for the block's groups, the rows of x within whose angle far the group may hold
        a row, by the triangle inequality."""
        of = self.of[block]
        step = max(1, CELLS_AT_ONCE // len(x))
        for lo in range(of.start, of.stop, step):
            g = slice(lo, min(lo + step, of.stop))
            cells, at = np.unique(self.cell[g], return_inverse=True)
            a = np.arccos(np.clip(centroids[cells] @ x.T, -1, 1))
            near, most = a - (far + TURN), a + (far + TURN)
            for n, c in enumerate(at.tolist(), lo):
                rows = np.flatnonzero((near[c] <= self.hi[n]) & (most[c] >= self.lo[n]))
                if len(rows):
                    yield n, rows

def _cosines(q: np.ndarray, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosines of the pairs, in float64, a bounded number at once."""
    out = np.empty(len(i))
    for lo in range(0, len(i), PAIRS_AT_ONCE):
        at = slice(lo, lo + PAIRS_AT_ONCE)
        out[at] = np.einsum("ij,ij->i", q[i[at]].astype(np.float64), x[j[at]].astype(np.float64))
    return out


def _best_each(i: np.ndarray, rank: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best ids of each i, an id once with its best cosine."""
    order = np.lexsort((-s, rank, i))
    once = order[np.r_[True, (np.diff(i[order]) != 0) | (np.diff(rank[order]) != 0)]] if len(order) else order
    return once[_keep_k(i[once], rank[once], s[once], k)]


def exact_pairs(q: np.ndarray, tau: np.ndarray, x: np.ndarray, rank: np.ndarray, most: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, stored row, cosine): of the pairs of a cosine of at least tau of the query, those of its
    k + 1 best ids (its own may be among them). The `most` best rows hold k + 1 ids."""
    s = q @ x.T
    hit = s >= tau[:, None] - SLACK
    i, j = np.divmod(np.flatnonzero(hit), len(x))
    if len(i) > 4 * most:
        many = np.flatnonzero(np.bincount(i) > 4 * most)
        for m in many:
            hit[m] &= s[m] >= np.partition(s[m], len(x) - most)[len(x) - most] - SLACK
        if len(many):
            i, j = np.divmod(np.flatnonzero(hit), len(x))
    cos = _cosines(q, i, x, j)
    if len(i) > (k + 1) * len(q):
        pick = _best_each(i, rank[j], cos, k + 1)
        i, j, cos = i[pick], j[pick], cos[pick]
    return i, j, cos


def _search(folder: str, plan: dict[str, Blocks], units: list[tuple[str, list[int]]], index: Coarse, dims: int, k: int, least: float):
    """applyInArrow over the rows (block, pos, tau) of a unit, which is some blocks of a space: the k best of
    its rows over all blocks of the space that they may reach, which are read one at a time."""

    def run(t: pa.Table) -> pa.Table:
        import pyarrow.fs as pfs

        fs, path = pfs.FileSystem.from_uri(folder)

        def block(name: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            with fs.open_input_file(f"{path}/{name}") as f:
                b = pa.ipc.open_file(f).read_all().combine_chunks()
            vec = b["vec"].combine_chunks()
            x = np.frombuffer(vec.buffers()[1], np.float32, len(vec) * dims, 4 * dims * vec.offset).reshape(-1, dims)
            return b["id"].combine_chunks(), x, b["rank"].to_numpy()

        space, mine = units[t["unit"][0].as_py()]
        p = plan[space]
        centroids = index.top if p.depth == 1 else index.leaf
        parts = [block(p.names[m]) for m in mine]
        ids = np.array([v for a in parts for v in a[0].to_pylist()], dtype=object)
        q = np.concatenate([a[1] for a in parts])
        del parts
        start = np.cumsum(np.r_[0, p.rows[mine]])
        number = {p.names[m]: n for n, m in enumerate(mine)}
        tau = np.full(len(q), least, np.float32)
        tau[start[[number[b] for b in t["block"].to_pylist()]] + t["pos"].to_numpy()] = t["tau"].to_numpy()
        held = [(np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0))]
        pairs = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i, to, s = (np.concatenate(z) for z in zip(*held))
            good = (ids[i] != to) & (s >= least)
            i, to, s = i[good], to[good], s[good]
            pick = _best_each(i, np.unique(to, return_inverse=True)[1], s, k)
            return i[pick], to[pick], s[pick]

        for other in [*mine, *(o for o in range(len(p.names)) if o not in set(mine))]:
            there = None
            far = np.arccos(np.clip(tau - np.float32(1e-5), -1, 1))
            for g, rows in p.reach(q, far, other, centroids):
                there = there or block(p.names[other])
                of = slice(p.first[g], p.first[g] + p.n[g])
                names, x, rank = there[0][of], there[1][of], there[2][of]
                most, step = min(len(x), (k + 1) * p.same[other]), max(1, CELLS_AT_ONCE // len(x))
                for lo in range(0, len(rows), step):
                    r = rows[lo : lo + step]
                    i, j, s = exact_pairs(q[r], tau[r], x, rank, most, k)
                    if len(i):
                        held.append((r[i], np.array(names.take(pa.array(j)).to_pylist(), dtype=object), s))
                        pairs += len(i)
                if pairs > HELD * k * len(q):
                    held = [merged()]
                    pairs = len(held[0][0])
                    n, low = np.bincount(held[0][0], minlength=len(q)), np.full(len(q), 9.0)
                    np.minimum.at(low, held[0][0], held[0][2])
                    tau = np.where(n >= k, np.maximum(tau, low.astype(np.float32)), tau)
        i, to, s = merged()
        return pa.table({"space": pa.array([space] * len(i), pa.string()), "id": pa.array(ids[i].tolist(), pa.string()), "neighbour": pa.array(to.tolist(), pa.string()), "cosine": pa.array(s, pa.float64())})

    return run


def _rest(work: DataFrame, best: DataFrame, index: Coarse, dims: int, k: int, least: float, max_cell: int) -> DataFrame:
    """Pairs of work (space, id, vec, depth, parts) that its cells do not show and that may be among the k
    best, given the best of the cells."""
    spark = work.sparkSession
    rows = work.where("depth > 0").select("space", "id", "vec", "depth", "parts")
    homes = rows.mapInArrow(_homes(index), "space string, id string, vec binary, depth int, parts int, cell bigint, angle double, shell int")
    homes = homes.withColumn("outer", F.col("shell") >= OUTER)
    homes = homes.repartition("space", "outer", F.pmod(F.hash("cell"), "parts")).sortWithinPartitions("space", "outer", "cell", "shell")
    folder = scratch_path(spark, "blocks")
    fs, path = hadoop_path(spark, folder)
    fs.mkdirs(path)
    stored = materialize(homes.mapInArrow(_store(folder, dims, max_cell), STORED), "stored")
    groups = stored.groupBy("space", "depth", "outer", "block", "same", "cell", "shell")
    groups = groups.agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    by_space: dict[str, list] = {}
    for g in groups.collect():
        by_space.setdefault(g["space"], []).append(g)
    plan = {s: Blocks(g) for s, g in by_space.items()}
    # a unit reads the others once for all its blocks, but every core should have units
    share = sum(int(p.rows.sum()) for p in plan.values()) // (8 * spark.sparkContext.defaultParallelism)
    units: list[tuple[str, list[int]]] = []
    for s, p in plan.items():
        held = UNIT * max_cell
        for b, n in enumerate(p.rows.tolist()):
            if held + n > min(max(share, max_cell), UNIT * max_cell):
                units.append((s, []))
                held = 0
            units[-1][1].append(b)
            held += n
    unit = spark.createDataFrame([(plan[s].names[b], u) for u, (s, blocks) in enumerate(units) for b in blocks], "block bigint, unit int")
    tau = best.groupBy("space", "id").agg(F.when(F.count("*") >= k, F.greatest(F.min("cosine"), F.lit(least))).otherwise(F.lit(least)).cast("float").alias("tau"))
    rows = stored.join(tau, ["space", "id"], "left").join(broadcast_if_small(unit, 100_000), "block")
    rows = rows.select("unit", "block", "pos", F.coalesce("tau", F.lit(float(least)).cast("float")).alias("tau"))
    # a number of partitions of its own: the rows are few bytes, the work is not
    return rows.repartition(2 * len(units), "unit").groupBy("unit").applyInArrow(_search(folder, plan, units, index, dims, k, least), OUT)


def nearest(
    vectors: DataFrame,
    dims: int,
    *,
    k: int = 5,
    least: float = -2.0,
    per_cell: int = 256,
    max_cell: int = 4096,
    margin: float = 0.2,
    most: int = 1,
) -> DataFrame:
    """space, id, neighbour, cosine: the k most similar others of every vector within its space.

    vectors: space, id (strings, not null), vec (unit float32 bytes; packed_vectors). Ties go to the smaller id.
    Repeated rows count once; an id with several vectors takes part with each, never with itself.
    least leaves out neighbours of a smaller cosine. Spaces of up to 2 * per_cell rows are one cell;
    larger ones use the coarse index, fitted on at most 32768 vectors, which every row is placed by;
    margin and most only say how much the first pass sees, the second one makes up for the rest.
    Of more than 32 equal vectors the first k + 1 ids stand for all: no other copy can be a
    neighbour of anything, and the other copies have the first k as their own neighbours.
    """
    spark = vectors.sparkSession
    base = materialize(vectors.withColumn("h", F.xxhash64("vec")), "vectors")
    sizes = materialize(base.groupBy("space").count(), "space-sizes")
    rows = sizes.agg(F.sum("count")).first()[0] or 0
    if rows == 0:
        return spark.createDataFrame([], OUT)
    index = Coarse(sample_matrix(base, dims, rows), rows, per_cell)
    depth = F.when(F.col("count") <= 2 * per_cell, 0).when(F.col("count") <= len(index.top) * per_cell, 1).otherwise(2)
    many = base.groupBy("space", "h").count().where("count > 32").select("space", "h")
    many = broadcast_if_small(materialize(many, "copies"), 100_000)
    parts = F.ceil(F.col("count") / (UNIT * max_cell)).cast("int").alias("parts")
    one = broadcast_if_small(sizes.select("space", depth.cast("int").alias("depth"), parts), 100_000)
    light = base.join(many, ["space", "h"], "left_anti")
    copies = base.join(many, ["space", "h"]).select("space", "h", "id", "vec").distinct()
    w = Window.partitionBy("space", "h").orderBy("id")
    first = materialize(copies.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1), "first-copies")
    work = light.select("space", "id", "vec").unionByName(first.select("space", "id", "vec")).join(one, "space")
    placed = work.mapInArrow(_place(index, dims, margin, most), "space string, cell bigint, id string, vec binary")
    big = placed.groupBy("space", "cell").count().where(F.col("count") > max_cell)
    big = materialize(big.select("space", "cell", F.ceil(F.col("count") / max_cell).cast("int").alias("blocks")), "big-cells")
    if big.isEmpty():
        tiles = placed.select("space", "cell", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side"), "id", "vec")
    else:
        b = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1),
            lambda o: F.struct(F.least(b, o).alias("bi"), F.greatest(b, o).alias("bj"), F.when(b > o, 1).otherwise(0).alias("side")),
        )
        cut = placed.join(broadcast_if_small(big, 100_000), ["space", "cell"], "left")
        tiles = cut.select("space", "cell", F.inline(pairs), "id", "vec")
    found = tiles.groupBy("space", "cell", "bi", "bj").applyInArrow(_tile(dims, k, least), OUT)
    heads = broadcast_if_small(first, 100_000)
    rest = copies.join(heads.select("space", "h", "id"), ["space", "h", "id"], "left_anti").select("space", "h", "id")
    heads = broadcast_if_small(first.where(F.col("n") <= k).select("space", "h", F.col("id").alias("neighbour")), 100_000)
    copied = rest.join(heads, ["space", "h"]).select("space", "id", "neighbour", F.lit(1.0).alias("cosine"))
    best = _best(found, k)
    if not one.where("depth > 0").isEmpty():
        best = materialize(best, "best-of-cells")
        more = _rest(work, best, index, dims, k, least, max_cell)
        best = _best(best.unionByName(more), k)
    return best.unionByName(copied)


def _best(found: DataFrame, k: int) -> DataFrame:
    # one shuffle by id serves the grouping and the window
    every = found.repartition("space", "id").groupBy("space", "id", "neighbour").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("space", "id").orderBy(F.round("cosine", 7).desc(), "neighbour")
    return every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
