"""Clusters of mutually similar vectors.

A vector becomes a set: for each of FEATURES random rotations the coordinate that is largest in
size, with its sign. MinHash bands over the set propose candidates, the exact Jaccard similarity of
the two sets verifies them, connected components of the verified links form groups. A group whose
members don't all lie near its medoid of highest degree is loose: it is split around medoids, the next
being the best linked member near none so far; pieces of the same direction are one group again. A group's members are its cluster, save those that the exact cosine to the cluster's mean
direction rules out. What the bands have missed is then searched for exactly, among the rows in no
cluster only: rows near a cluster's mean join it, and small and loose clusters are found by exact
neighbours.

Within a bucket a row is compared with the bucket's leaders, not with every other row. Buckets are
reduced to their leaders inside each task before the shuffle, so a bucket that holds a large share
of all rows sends few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.llm.graph import connected_components
from lumenq.llm.neighbours import nearest, rotation
from lumenq.llm.vectors import matrix
from lumenq.util import broadcast_if_small, materialize

FEATURES = 64
BANDS = 16
ROWS = 2
CHUNK = 50_000


class Features:
    """The sets of vectors and their MinHash bands."""

    def __init__(self, dims: int, bands: int = BANDS, rows: int = ROWS):
        self.turns = [rotation(dims, 100 + t) for t in range(FEATURES)]
        rng = np.random.default_rng(17)
        self.salt = rng.integers(1, 2**32, size=(bands * rows, FEATURES, 2 * self.turns[0].shape[1]), dtype=np.uint32)
        self.bands, self.rows = bands, rows

    def sets(self, x: np.ndarray) -> np.ndarray:
        """uint8 [n, FEATURES]: element t of a row's set is (t, value)."""
        out = np.empty((len(x), FEATURES), np.uint16 if self.salt.shape[2] > 256 else np.uint8)
        for t, r in enumerate(self.turns):
            y = x @ r
            j = np.abs(y).argmax(axis=1)
            out[:, t] = 2 * j + (y[np.arange(len(x)), j] > 0)
        return out

    def keys(self, sets: np.ndarray) -> np.ndarray:
        """int64 [n, bands]: the bucket of each band."""
        out = np.empty((len(sets), self.bands), np.int64)
        col = np.arange(FEATURES)
        for b in range(self.bands):
            key = np.full(len(sets), b + 1, np.uint64)
            for r in range(self.rows):
                low = self.salt[b * self.rows + r][col[None, :], sets].min(axis=1).astype(np.uint64)
                key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, b] = key.view(np.int64)
        return out


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = (a == b).sum(axis=1)
    return same / (2 * a.shape[1] - same)


def leader_links(key: np.ndarray, sets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, its leader) for rows whose Jaccard with a leader of their bucket is least or more, and
    the leaders. The first row of a bucket leads; rows unlike it follow the next leader."""
    rest = np.argsort(key, kind="stable")
    rows, heads, leaders = [], [], []
    while len(rest):
        k = key[rest]
        first = np.r_[True, k[1:] != k[:-1]]
        head = rest[np.maximum.accumulate(np.where(first, np.arange(len(rest)), 0))]
        leaders.append(rest[first])
        other = ~first
        good = np.zeros(len(rest), bool)
        good[other] = jaccard(sets[rest[other]], sets[head[other]]) >= least
        rows.append(rest[good])
        heads.append(head[good])
        rest = rest[other & ~good]
    z = np.zeros(0, np.int64)
    return np.concatenate(rows or [z]), np.concatenate(heads or [z]), np.concatenate(leaders or [z])


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


NODES = "kind int, nid bigint, root bigint, links bigint, bucket bigint, sig binary"


def _reduce_chunks(dims: int, least: float, bands: int):
    """mapInArrow: (nid, vec) -> kind 0: the rows with their root in the chunk and number of links;
    kind 1: the leaders of each bucket of the chunk."""

    def one(nid: np.ndarray, x: np.ndarray, f: Features) -> Iterator[pa.RecordBatch]:
        sets = f.sets(x)
        keys = f.keys(sets)
        ends, leads = [], []
        for b in range(keys.shape[1]):
            r, h, lead = leader_links(keys[:, b], sets, least)
            ends.append((r, h))
            leads.append(lead)
        a, b2 = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
        pair = np.unique(np.stack([a, b2], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        root = nid[local_roots(len(nid), pair[:, 0], pair[:, 1])]
        links = np.bincount(pair.ravel(), minlength=len(nid))
        n = len(nid)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), pa.array(nid), pa.array(root), pa.array(links), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
            names=["kind", "nid", "root", "links", "bucket", "sig"],
        )
        for b, lead in enumerate(leads):
            m = len(lead)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(m, np.int32)),
                    pa.array(nid[lead]),
                    pa.array(root[lead]),
                    pa.nulls(m, pa.int64()),
                    pa.array(keys[lead, b]),
                    pa.array([s.tobytes() for s in sets[lead]], pa.binary()),
                ],
                names=["kind", "nid", "root", "links", "bucket", "sig"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(dims, bands)
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                t = pa.Table.from_batches(held)
                yield from one(t["nid"].to_numpy(), matrix(t["vec"], dims), f)
                held, rows = [], 0
        if rows:
            t = pa.Table.from_batches(held)
            yield from one(t["nid"].to_numpy(), matrix(t["vec"], dims), f)

    return run


def _link_leaders(least: float):
    """mapInArrow over leaders sorted by bucket -> (a, b, root_a, root_b) of verified links. What is
    kept of the open bucket between batches is its leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if kept is not None:
                t = pa.concat_tables([kept, t])
            if not t.num_rows:
                continue
            key, nid, root = (t[c].to_numpy() for c in ("bucket", "nid", "root"))
            sig = t["sig"].to_pylist()
            sets = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1)
            r, h, lead = leader_links(key, sets, least)
            kept = t.take(pa.array(np.sort(lead[key[lead] == key[-1]])))
            yield pa.RecordBatch.from_arrays([pa.array(nid[r]), pa.array(nid[h]), pa.array(root[r]), pa.array(root[h])], names=["a", "b", "root_a", "root_b"])

    return run


def linked_groups(rows: DataFrame, dims: int, *, least: float, bands: int = BANDS) -> DataFrame:
    """nid, grp, links: the connected component of every row (its smallest nid) and its number of
    verified links. rows: nid (unique), vec."""
    parts = materialize(rows.select("nid", "vec").mapInArrow(_reduce_chunks(dims, least, bands), NODES), "buckets", ["kind"])
    own = parts.where("kind = 0").select("nid", "root", "links")
    leaders = parts.where("kind = 1").select("bucket", "nid", "root", "sig")
    links = leaders.repartition("bucket").sortWithinPartitions("bucket", "nid").mapInArrow(_link_leaders(least), "a bigint, b bigint, root_a bigint, root_b bigint")
    links = materialize(links, "leader-links")
    joined = connected_components(links, "root_a", "root_b")
    grp = own.join(joined, own["root"] == joined["node"], "left").select("nid", F.coalesce("component", "root").alias("grp"), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count("*").alias("more"))
    return grp.join(ends, "nid", "left").select("nid", "grp", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"))


def mean_directions(rows: DataFrame, key: str, dims: int) -> DataFrame:
    """key, mean (unit float32 bytes), n: per key the direction of the sum of its vectors. Tasks add
    up their own rows first, so a large group sends one row per flush and task."""
    kind = rows.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> pa.RecordBatch:
            ks = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int64()), pa.array([held[k][0].tobytes() for k in ks], pa.binary()), pa.array([held[k][1] for k in ks], pa.int64())],
                names=[key, "total", "n"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            ks, inv = np.unique(t[key].to_numpy(), return_inverse=True)
            total = np.zeros((len(ks), dims))
            np.add.at(total, inv, matrix(t["vec"], dims).astype(np.float64))
            n = np.bincount(inv)
            for i, k in enumerate(ks.tolist()):
                if k in held:
                    held[k] = (held[k][0] + total[i], held[k][1] + int(n[i]))
                else:
                    held[k] = (total[i], int(n[i]))
            if len(held) > 50_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    def whole(t: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(t["total"].to_pylist()), np.float64).reshape(-1, dims).sum(axis=0)
        n = np.linalg.norm(v)
        return pa.table({key: t[key].slice(0, 1).combine_chunks(), "mean": pa.array([(v / (n or 1)).astype(np.float32).tobytes()], pa.binary()), "n": pa.array([int(t["n"].to_numpy().sum())])})

    parts = rows.select(key, "vec").mapInArrow(partial, f"{key} {kind}, total binary, n bigint")
    return parts.groupBy(key).applyInArrow(whole, f"{key} {kind}, mean binary, n bigint")


def cosine(a: str, b: str):
    """Cosine of two columns of unit float32 bytes."""

    @F.pandas_udf("double")
    def dot(x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype="float64")
        p, q = (np.frombuffer(b"".join(v), np.float32).reshape(len(v), -1).astype(np.float64) for v in (x, y))
        return pd.Series(np.einsum("ij,ij->i", p, q))

    return dot(a, b)


IN_TASK = 16_384  # rows of a group that one task splits


def _peel(near: float):  # noqa: ANN202
    """applyInArrow over a group (nid, grp, links, vec): nid, grp (the medoid), vec of its tight pieces."""

    def run(t: pa.Table) -> pa.Table:
        nid, links = t["nid"].to_numpy(), t["links"].to_numpy()
        order = np.lexsort((nid, -links))
        t, nid = t.take(pa.array(order)), nid[order]
        x = np.frombuffer(b"".join(t["vec"].to_pylist()), np.float32).reshape(len(t), -1)
        medoids, left = [], np.arange(len(nid))
        while len(left):
            medoids.append(int(left[0]))
            close = x[left] @ x[left[0]] >= near
            close[0] = True
            left = left[~close]
        at = np.concatenate([(x[lo : lo + 1024] @ x[medoids].T).argmax(axis=1) for lo in range(0, len(x), 1024)])
        grp = nid[np.array(medoids)[at]]
        _, back, n = np.unique(grp, return_inverse=True, return_counts=True)
        several = pa.array(n[back] > 1)  # a row alone is no group
        return pa.table({"nid": t["nid"], "grp": pa.array(grp), "vec": t["vec"]}).filter(several)

    return run


def _heads(near: float):  # noqa: ANN202
    """applyInArrow over a group's medoids (grp, links, nid, vec): those that no better one is near."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort((t["nid"].to_numpy(), -t["links"].to_numpy()))))
        x = np.frombuffer(b"".join(t["vec"].to_pylist()), np.float32).reshape(len(t), -1)
        kept: list[int] = []
        for i in range(len(x)):
            if not kept or (x[kept] @ x[i]).max() < near:
                kept.append(i)
        u = t.take(pa.array(kept))
        return pa.table({"grp": t["grp"].slice(0, 1).combine_chunks(), "medoids": pa.array([u["nid"].to_pylist()], pa.list_(pa.int64())), "mvecs": pa.array([b"".join(u["vec"].to_pylist())], pa.binary())})

    return run


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, grp, links, vec, medoids, mvecs) -> nid, links, vec, the most similar medoid of the group, the cosine."""
    for b in batches:
        t = pa.Table.from_batches([b])
        grp = t["grp"].to_numpy()
        for g in np.unique(grp):
            u = t.filter(pa.array(grp == g))
            x = np.frombuffer(b"".join(u["vec"].to_pylist()), np.float32).reshape(len(u), -1)
            m = np.frombuffer(u["mvecs"][0].as_py(), np.float32).reshape(-1, x.shape[1])
            s = x @ m.T
            at = s.argmax(axis=1)
            yield from pa.table({"nid": u["nid"], "links": u["links"], "vec": u["vec"], "medoid": pa.array(np.array(u["medoids"][0].as_py())[at]), "cos": pa.array(s[np.arange(len(s)), at].astype(np.float64)), "grp": u["grp"]}).combine_chunks().to_batches()


def split_loose(grouped: DataFrame, *, near: float, in_task: int = IN_TASK) -> DataFrame:
    """nid, grp, vec of the tight groups in grouped (nid, grp, links, vec); grp is the medoid's nid.

    The medoid of a group is its member with most links, then the smallest nid. A group is tight
    when every member has a cosine of near or more to the medoid. A loose one is split: the best linked
    of the members that are not near is a medoid too, and so on until each is near one; a member goes
    with the most similar of them. A group of up to in_task rows is split in one task. A larger one
    is cut first, in rounds: the best linked row of each of its hash parts (one part for half of
    in_task rows) is a medoid unless a better linked one is near it, and a row goes to the most
    similar of them; so rounds grow with the logarithm of the group.
    """
    done: DataFrame | None = None
    left = grouped
    while True:
        size = materialize(left.groupBy("grp").count().where(F.col("count") > in_task), "large-groups")
        if size.isEmpty():
            break
        parts = F.least(F.lit(16_384), F.ceil(F.col("count") / (in_task // 2 or 1))).cast("bigint")
        marked = left.join(broadcast_if_small(size.select("grp", parts.alias("parts")), 100_000), "grp", "left")
        small = marked.where("parts IS NULL").drop("parts")
        large = materialize(marked.where("parts IS NOT NULL"), "loose")
        best = large.groupBy("grp", F.pmod(F.xxhash64("nid"), F.col("parts")).alias("part")).agg(F.max_by(F.struct("links", "nid", "vec"), F.struct("links", -F.col("nid"))).alias("m"))
        heads = materialize(best.select("grp", "m.*").groupBy("grp").applyInArrow(_heads(near), "grp bigint, medoids array<bigint>, mvecs binary"), "medoids")
        seen = large.select("nid", "grp", "links", "vec").join(broadcast_if_small(heads, 64), "grp").mapInArrow(_around, "nid bigint, links bigint, vec binary, medoid bigint, cos double, grp bigint")
        seen = materialize(seen, "around")
        tight = seen.where(F.col("cos") >= near).select("nid", F.col("medoid").alias("grp"), "vec")
        tight = tight if done is None else done.unionByName(tight)
        done = tight
        left = materialize(small.unionByName(seen.where(F.col("cos") < near).select("nid", "grp", "links", "vec")), "left")
    rest = left.groupBy("grp").applyInArrow(_peel(near), "nid bigint, grp bigint, vec binary")
    return rest if done is None else done.unionByName(rest)


MEANS_AT_ONCE = 16_384


def assign(rows: DataFrame, means: DataFrame, dims: int, *, near: float) -> DataFrame:
    """nid, grp, cos: for every row the mean of largest cosine, where it is near or more; of equal
    ones the smallest grp.

    rows: nid, vec; means: grp, mean. The means go to the tasks in blocks of about MEANS_AT_ONCE (4 MB
    at 64 dimensions), with a pass over the rows each; a row's best over the blocks counts.
    """
    blocks = -(-means.count() // MEANS_AT_ONCE)
    shape = "nid bigint, grp bigint, cos double"
    found: DataFrame | None = None
    for k in range(blocks):
        few = means.where(F.pmod(F.xxhash64("grp"), F.lit(blocks)) == k).select("grp", "mean").collect()
        if not few:
            continue
        few.sort(key=lambda r: r["grp"])
        grp = np.array([r["grp"] for r in few], np.int64)
        c = np.frombuffer(b"".join(bytes(r["mean"]) for r in few), np.float32).reshape(-1, dims)

        def every(batches: Iterator[pa.RecordBatch], grp: np.ndarray = grp, c: np.ndarray = c) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(1), dims)
                for lo in range(0, len(x), 1024):
                    s = x[lo : lo + 1024] @ c.T
                    best = s.argmax(axis=1)
                    v = s[np.arange(len(s)), best]
                    ok = np.flatnonzero(v >= near)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok + lo)), pa.array(grp[best[ok]]), pa.array(v[ok].astype(np.float64))], names=["nid", "grp", "cos"])

        part = rows.select("nid", "vec").mapInArrow(every, shape)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], shape)
    if blocks == 1:
        return found
    return found.groupBy("nid").agg(F.max_by("grp", F.struct("cos", -F.col("grp"))).alias("grp"), F.max("cos").alias("cos"))


def _alike(means: DataFrame, dims: int, same: float) -> DataFrame | None:
    """a, b: pairs of means with a cosine of same or more (up to 4096 means: all of them, compared in
    one block; else each mean's eight most similar), or None if there are none."""
    spark = means.sparkSession
    if means.limit(4097).count() <= 4096:
        rows = sorted((r["grp"], bytes(r["mean"])) for r in means.select("grp", "mean").collect())  # 1 MB
        x = np.frombuffer(b"".join(v for _, v in rows), np.float32).reshape(-1, dims)
        i, j = np.nonzero(np.triu(x @ x.T >= same, 1))
        return spark.createDataFrame([(rows[a][0], rows[b][0]) for a, b in zip(i.tolist(), j.tolist())], "a bigint, b bigint") if len(i) else None
    near = nearest(means.select(F.lit("").alias("space"), F.col("grp").cast("string").alias("id"), F.col("mean").alias("vec")), dims, k=8, least=same)
    near = materialize(near.select(F.col("id").cast("bigint").alias("a"), F.col("neighbour").cast("bigint").alias("b")), "alike")
    return None if near.isEmpty() else near


def joined_groups(rows: DataFrame, dims: int, *, same: float) -> tuple[DataFrame, DataFrame]:
    """rows (nid, grp, vec) with groups whose mean directions have a cosine of same or more as one, and
    grp, mean, n of the groups. Repeated until no two means are that similar."""
    rows = materialize(rows.select("nid", "grp", "vec"), "grouped")
    means = materialize(mean_directions(rows, "grp", dims), "means")
    while (alike := _alike(means, dims, same)) is not None:
        joined = connected_components(alike, "a", "b").withColumnRenamed("node", "grp")
        rows = rows.join(broadcast_if_small(joined, 100_000), "grp", "left").select("nid", F.coalesce("component", "grp").alias("grp"), "vec")
        rows = materialize(rows, "grouped")
        means = materialize(mean_directions(rows, "grp", dims), "means")
    return rows, means


def near_mean(rows: DataFrame, means: DataFrame, *, near: float) -> DataFrame:
    """The rows (nid, grp, vec) with a cosine of near or more to their own group's mean."""
    both = rows.join(broadcast_if_small(means.select("grp", "mean"), 20_000), "grp")
    return both.withColumn("cosine", cosine("vec", "mean")).where(F.col("cosine") >= near).drop("mean")


def members_of(rows: DataFrame, means: DataFrame, dims: int, *, near: float) -> DataFrame:
    """nid, grp, vec of the rows (nid, vec) within near of a mean; grp of the nearest."""
    return materialize(assign(rows, means, dims, near=near).select("nid", "grp").join(rows.select("nid", "vec"), "nid"), "members")


def loose_groups(left: DataFrame, dims: int, *, size: int, near: float, apart: float, same: float) -> DataFrame:
    """nid, grp, vec: groups among rows in no group of size yet (nid, vec), too small or too loose for the bands.

    In a cluster of size or more members, each of a cosine of near or more to the mean, a member's
    cosines to all n members add up to n * near^2 at least, so those to its size - 1 nearest others
    reach size * near^2 - 1, and none of them is under 2 * near^2 - 1. Every row that meets this is
    the seed of a group with these neighbours; groups of the same direction are one, and are drawn
    together around their means. grp is negative, so it is none of the other groups'.
    """
    shape = left.select("nid", F.lit(0).cast("bigint").alias("grp"), "vec")
    left = materialize(left.select("nid", "vec"), "left")
    named = left.select(F.lit("").alias("space"), F.col("nid").cast("string").alias("id"), "vec")
    pairs = nearest(named, dims, k=size - 1, least=2 * near**2 - 1).select(F.col("id").cast("bigint").alias("grp"), F.col("neighbour").cast("bigint").alias("nid"), "cosine")
    pairs = materialize(pairs, "near-left")
    seeds = pairs.groupBy("grp").agg(F.count("*").alias("n"), F.sum("cosine").alias("total"))
    seeds = materialize(seeds.where((F.col("n") == size - 1) & (F.col("total") >= size * near**2 - 1 - 1e-5)).select("grp"), "seeds")
    if seeds.isEmpty():
        return shape.limit(0)
    held = pairs.select("grp", "nid").join(seeds, "grp", "left_semi").unionByName(seeds.select("grp", F.col("grp").alias("nid")))
    held = held.join(left, "nid").select("nid", (-1 - F.col("grp")).alias("grp"), "vec")
    for limit in (apart, near):
        _, means = joined_groups(held, dims, same=same)
        held = members_of(left, means, dims, near=limit)
    return held


CLUSTERS = "id string, cluster bigint, cosine double"


def similarity_clusters(
    vectors: DataFrame, dims: int, *, size: int = 8, near: float = 0.74, least: float = 0.13, apart: float = 0.65, same: float = 0.85, bands: int = BANDS, in_task: int = IN_TASK
) -> DataFrame:
    """id, cluster, cosine (to the cluster's mean direction): the records that belong to a cluster.

    vectors: id, vec (unit float32 bytes). An id counts once, with the smallest of its vectors if it
    has several; null ids are left out. Links are verified at a Jaccard similarity of least; apart is
    the cosine to its medoid that a member of a group must have; groups whose mean directions have a
    cosine of same or more are one. A group's members with a cosine of near or more to its mean are
    its cluster. Rows in no cluster of size members after that are searched exactly: those within
    near of a cluster's mean join the nearest, the rest by loose_groups. Clusters under size members
    and records near no cluster are left out. Empty input gives no rows.
    """
    spark = vectors.sparkSession
    once = vectors.where("id IS NOT NULL").groupBy("id").agg(F.min("vec").alias("vec"))
    base = materialize(once.withColumn("nid", F.monotonically_increasing_id()), "cluster-base")
    if base.isEmpty():
        return spark.createDataFrame([], CLUSTERS)
    groups = materialize(linked_groups(base, dims, least=least, bands=bands), "groups")
    several = groups.groupBy("grp").count().where("count > 1").select("grp")
    grouped = groups.join(several, "grp", "left_semi").join(base.select("nid", "vec"), "nid")
    rows, means = joined_groups(split_loose(grouped, near=apart, in_task=in_task), dims, same=same)
    kept = materialize(near_mean(rows, means.where(F.col("n") >= size), near=near), "kept")
    means = materialize(mean_directions(kept, "grp", dims).where(F.col("n") >= size), "means")
    kept = kept.join(means.select("grp"), "grp", "left_semi")
    left = materialize(base.join(kept.select("nid"), "nid", "left_anti"), "left")  # what the bands missed, and what is near no cluster
    late = members_of(left, means, dims, near=near)
    loose = loose_groups(left.join(late.select("nid"), "nid", "left_anti"), dims, size=size, near=near, apart=apart, same=same)
    parts = [x.select("nid", "grp", "vec") for x in (kept, late, loose)]
    rows, means = joined_groups(parts[0].unionByName(parts[1]).unionByName(parts[2]), dims, same=same)
    members = near_mean(rows, means.where(F.col("n") >= size), near=near)
    return members.join(base.select("nid", "id"), "nid").select("id", F.col("grp").alias("cluster"), "cosine")
