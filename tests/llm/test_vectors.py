import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lumenq.llm import clusters, graph, neighbours, vectors


def brute(rows, k, least):
    out = set()
    for a, v in rows:
        s = sorted(((-round(float(v @ w), 9), b) for b, w in rows if b != a))[:k]
        out |= {(a, b) for d, b in s if -d >= least}
    return out


def frame(spark, rows):
    data = [(s, i, None if v is None else [float(x) for x in v], "clash") for s, i, v in rows]
    return spark.createDataFrame(data, "space string, id string, vector array<float>, vec string")


def unit(v):
    v = np.asarray(v, np.float64)
    v = (v / np.abs(v).max())
    return (v / np.sqrt((v * v).sum())).astype(np.float32)


@pytest.mark.parametrize("max_cell", [4096, 60])
def test_neighbours_against_brute_force(spark, max_cell):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 64))
    rows = [("s", f"i{n}", centres[n % 6] + 0.4 * rng.standard_normal(64)) for n in range(240)]
    rows += [("t", f"j{n}", rng.standard_normal(64)) for n in range(20)]
    rows += rows[:5]  # repeated rows
    odd = [("s", "null", None), ("s", "short", [1.0]), ("s", "zero", np.zeros(64)), ("s", "nan", np.full(64, np.nan)), ("s", "inf", np.r_[np.inf, np.ones(63)])]
    packed = vectors.packed_vectors(frame(spark, rows + odd), ["space", "id"], "vector", 64)
    assert packed.count() == len(rows)
    for least in (-2.0, 0.75):
        got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(packed, 64, k=5, least=least, max_cell=max_cell).collect()}
        want = set()
        for s in "st":
            want |= brute([(i, unit(np.float32(v))) for p, i, v in dict(((r[0], r[1]), r) for r in rows).values() if p == s], 5, least)
        assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want) + 1


def test_index_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 64))
    rows = [("s", f"i{n:05}", centres[n % 40] + 0.3 * rng.standard_normal(64)) for n in range(3000)]
    packed = vectors.packed_vectors(frame(spark, rows), ["space", "id"], "vector", 64)
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(packed, 64, k=5, per_cell=200).collect()}
    x = np.array([unit(np.float32(v)) for *_, v in rows])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(rows[i][1], rows[j][1]) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) / len(want) >= 0.95


@pytest.mark.parametrize("least", [-2.0, 0.75])
def test_dense_cluster_over_many_cells(spark, least):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((20, 64))
    rows = [("s", f"d{n:04}", centres[0] + 0.4 * rng.standard_normal(64)) for n in range(1000)]
    rows += [("s", f"i{n:04}", centres[n % 20] + 0.4 * rng.standard_normal(64)) for n in range(1700)]
    rows += [("s", f"n{n:04}", rng.standard_normal(64)) for n in range(300)]
    packed = vectors.packed_vectors(frame(spark, rows), ["space", "id"], "vector", 64)
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(packed, 64, k=5, least=least, per_cell=50, max_cell=200).collect()}
    x = np.array([unit(np.float32(v)) for *_, v in rows]).astype(np.float64)
    s = x @ x.T
    np.fill_diagonal(s, -3)
    want = {(rows[i][1], rows[j][1]) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= least}
    assert got == want


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_with_all_cells():
    """What a task holds with 4096 cells, as tables of over a million rows have."""
    rng = np.random.default_rng(41)
    x = np.array([unit(v) for v in rng.standard_normal((9000, 64))])
    index = vectors.Coarse(x[:8192], 1, 256)
    index.leaf = x[:4096]
    (r, c), mb = peak_mb(lambda: index.cells(x, 2, 0.2, 1))
    assert mb < 60 and (r == np.arange(9000)).all() and (c == (x @ index.leaf.T).argmax(axis=1)).all()
    rows = pa.RecordBatch.from_pydict({"space": ["s"] * 9000, "id": [f"i{n}" for n in range(9000)], "vec": [v.tobytes() for v in x], "depth": pa.array([2] * 9000, pa.int32())})
    homes, mb = peak_mb(lambda: list(neighbours._homes(index)(iter([rows]))))
    assert mb < 60 and (pa.Table.from_batches(homes)["cell"].to_numpy() == c).all()


@pytest.mark.parametrize("least", [-2.0, 0.75])
def test_tasks_of_several_blocks(spark, least):
    rng = np.random.default_rng(43)
    centres = rng.standard_normal((8, 64))
    rows = [("s", f"i{n:04}", centres[n % 8] + 0.4 * rng.standard_normal(64)) for n in range(1000)]
    rows += [("s", f"n{n:04}", rng.standard_normal(64)) for n in range(150)]
    rows += [("s", f"t{n:04}", centres[0] + 1e-5 * rng.standard_normal(64)) for n in range(60)]  # these nearly tie
    rows += [("s", "several", centres[1] + 0.2 * rng.standard_normal(64)) for _ in range(30)]
    packed = vectors.packed_vectors(frame(spark, rows), ["space", "id"], "vector", 64)
    got = sorted((r["id"], r["neighbour"]) for r in neighbours.nearest(packed, 64, k=5, least=least, per_cell=40, max_cell=20).collect())
    x = np.array([unit(np.float32(v)) for *_, v in rows]).astype(np.float64)
    best = {}
    for (_, a, _), line in zip(rows, x @ x.T):
        for (_, b, _), c in zip(rows, line):
            if a != b and c >= least and c > best.setdefault(a, {}).get(b, -9):
                best[a][b] = c
    want = [(a, b) for a, to in best.items() for b, _ in sorted(to.items(), key=lambda p: (-round(p[1], 7), p[0]))[:5]]
    assert got == sorted(want)


def test_many_copies(spark):
    rng = np.random.default_rng(8)
    same, other = rng.standard_normal(64), rng.standard_normal(64)
    rows = [("s", f"c{n:03}", same) for n in range(50)] + [("s", "near", same + 0.01 * other), ("s", "far", other)]
    packed = vectors.packed_vectors(frame(spark, rows), ["space", "id"], "vector", 64)
    got = {}
    for r in neighbours.nearest(packed, 64, k=3).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert got["c049"] == {"c000", "c001", "c002"} and got["c000"] == {"c001", "c002", "c003"} and got["near"] == {"c000", "c001", "c002"}
    assert len(got) == 52 and all(len(v) == 3 for v in got.values())


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(9)
    x = np.array([unit(v) for v in rng.standard_normal((400, 64)) + 1])
    c = x.mean(0)
    codes = neighbours.Codes(x, c, neighbours.rotation(64))
    est, bound = neighbours.estimates(codes, codes, np.arange(100), float(c @ c))
    off = np.abs(est - x[:100] @ x.T) > bound
    off[np.arange(100), np.arange(100)] = False
    assert off.mean() < 0.01


def test_empty_vectors(spark):
    packed = vectors.packed_vectors(frame(spark, [("s", "a", None)]), ["space", "id"], "vector", 64)
    assert neighbours.nearest(packed, 64).count() == 0
    assert clusters.similarity_clusters(packed.select("id", "vec"), 64).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7), (None, 5), (200, 201), (102, 100)]
    got = graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


@pytest.mark.parametrize("in_task", [16_384, 20])
def test_clusters(spark, in_task):
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((5, 64))
    centres[1] = unit(unit(centres[0]) + 0.9 * unit(centres[1])) * 8  # two that are rather near
    rows = []
    for c in range(5):
        for n in range((60, 30, 12, 8, 5)[c]):
            rows.append((f"c{c}-{n:02}", unit(unit(centres[c]) * 8 + 0.5 * rng.standard_normal(64))))
    rows += [(f"copy{n}", rows[0][1]) for n in range(40)] + [(f"noise{n}", unit(rng.standard_normal(64))) for n in range(60)] + rows[:7] + [(None, rows[0][1])]
    df = spark.createDataFrame([(i, v.tobytes(), "x") for i, v in rows], "id string, vec binary, cluster string")
    got = {}
    for r in clusters.similarity_clusters(df, 64, in_task=in_task).collect():
        assert r["id"] not in got
        got[r["id"]] = r["cluster"]
    groups = {}
    for i, g in got.items():
        groups.setdefault(g, set()).add(i.split("-")[0] if i[0] == "c" and i[1] != "o" else "c0" if i.startswith("copy") else i)
    assert sorted(next(iter(g)) for g in groups.values()) == ["c0", "c1", "c2", "c3"] and all(len(g) == 1 for g in groups.values())
    assert len(got) == 60 + 30 + 12 + 8 + 40


def loose_cluster(rng, n, lo, hi):
    """n unit rows of cosines lo to hi to their centre."""
    c = unit(rng.standard_normal(64))
    z = rng.standard_normal((n, 64))
    z -= np.outer(z @ c, c)
    z -= z.mean(0)
    t = rng.uniform(lo, hi, n)[:, None]
    return (t * c + np.sqrt(1 - t * t) * z / np.linalg.norm(z, axis=1)[:, None]).astype(np.float32)


def test_small_loose_clusters(spark):
    rng = np.random.default_rng(21)
    rows = [(f"c{c:02}-{n}", v) for c in range(30) for n, v in enumerate(loose_cluster(rng, 8, 0.80, 0.85))]
    rows += [(f"d-{n:02}", v) for n, v in enumerate(loose_cluster(rng, 60, 0.80, 0.95))]
    rows += [(f"noise{n}", unit(rng.standard_normal(64))) for n in range(300)]
    df = spark.createDataFrame([(i, v.tobytes()) for i, v in rows], "id string, vec binary")
    groups = {}
    for r in clusters.similarity_clusters(df, 64).collect():
        groups.setdefault(r["cluster"], []).append(r["id"])
    want = {}
    for i, _ in rows[:300]:
        want.setdefault(i.split("-")[0], []).append(i)
    assert sorted(sorted(g) for g in groups.values()) == sorted(want.values())


def test_assign_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(23)
    groups = [loose_cluster(rng, 8, 0.78, 0.79) for _ in range(400)]
    rows = spark.createDataFrame([(8 * g + n, v.tobytes()) for g, x in enumerate(groups) for n, v in enumerate(x)], "nid bigint, vec binary")
    means = spark.createDataFrame([(g, unit(x.sum(0)).tobytes()) for g, x in enumerate(groups)], "grp bigint, mean binary")
    for most in (500, 70):
        monkeypatch.setattr(clusters, "MEANS_AT_ONCE", most)
        got = sorted((r["nid"], r["grp"]) for r in clusters.assign(rows, means, 64, near=0.74).collect())
        assert got == [(i, i // 8) for i in range(3200)]


def test_split_of_a_chain(spark):
    """A component of many chained clusters, cut over tasks and within one."""
    rng = np.random.default_rng(31)
    groups = [loose_cluster(rng, 12, 0.9, 0.95) for _ in range(40)]
    rows = [(12 * g + n, 0, n, v.tobytes()) for g, x in enumerate(groups) for n, v in enumerate(x)]
    df = spark.createDataFrame(rows, "nid bigint, grp bigint, links bigint, vec binary")
    for in_task in (1000, 100, 8):
        got = {r["nid"]: r["grp"] for r in clusters.split_loose(df, near=0.65, in_task=in_task).collect()}
        pieces = {}
        for nid, grp in got.items():
            pieces.setdefault(grp, set()).add(nid // 12)
        assert all(len(p) == 1 for p in pieces.values()) and len(got) >= 0.97 * len(rows)
    whole, means = clusters.joined_groups(clusters.split_loose(df, near=0.65, in_task=100), 64, same=0.85)
    assert means.count() == 40


def test_leader_links():
    key = np.array([1, 1, 1, 2, 2])
    sets = np.array([[1, 2], [1, 2], [9, 9], [1, 2], [1, 3]], np.uint8)
    r, h, lead = clusters.leader_links(key, sets, 0.5)
    assert list(zip(r, h)) == [(1, 0)] and sorted(lead) == [0, 2, 3, 4]
    assert clusters.local_roots(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]
