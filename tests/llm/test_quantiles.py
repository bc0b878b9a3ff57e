import numpy as np

from lumenq.llm import quantiles as Q


def test_leaves_keep_order():
    v = np.sort(np.r_[np.random.default_rng(0).standard_normal(1000) * 1e3, 0.0, -0.0, 1e-300, -1e300, 1e300, np.inf, -np.inf])
    leaf = Q.leaf_of(v)
    assert (np.diff(leaf) >= 0).all() and leaf.min() >= 1 << Q.BITS and leaf.max() < 2 << Q.BITS
    f = v[np.isfinite(v) & (np.abs(v) > 1e-200)]
    assert np.allclose(Q.leaf_value(Q.leaf_of(f)), f, rtol=2.0**-8)


def test_rank_error_is_bounded():
    rng = np.random.default_rng(1)
    v = np.sort(np.exp(rng.standard_normal(60_000) * 2))
    node, n = np.unique(Q.leaf_of(v), return_counts=True)
    for eps in (0.001, 0.01, 0.05):
        a, b = Q.compress(node, n, rank_error=eps)
        assert b.sum() == len(v) and len(a) <= 3 * Q.BITS / eps and len(np.unique(a)) == len(a)
        got = Q.percentiles_of(a, b, [1, 10, 50, 90, 99])
        for p, x in zip([1, 10, 50, 90, 99], got):
            lo, hi = np.searchsorted(v, [x * (1 - 2**-7), x * (1 + 2**-7)])
            want = p * len(v) / 100
            assert lo - eps * len(v) - 1 <= want <= hi + eps * len(v) + 1
    assert len(Q.compress(node, n, rank_error=0.05)[0]) < len(node)


def test_merging_parts_equals_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{i % 3}" if i % 5 else None, f"d{i % 4}", float(rng.integers(0, 50)) if i % 7 else None, i) for i in range(3000)]
    rows += [("g0", "d0", float("nan"), 1), ("only", "d0", None, 2)]
    df = spark.createDataFrame(rows, "g string, day string, value double, node int").repartition(5)
    at = Q.percentile_columns([10, 50, 90])
    whole = {r["g"]: r["p"] for r in Q.digests(df.select("g", "day", "value"), ["g"], "value").select("g", at.alias("p")).collect()}
    parts = Q.digests(df.select("g", "day", "value"), ["g", "day"], "value")
    merged = {r["g"]: r["p"] for r in Q.merge(parts, ["g"]).select("g", at.alias("p")).collect()}
    assert whole == merged and set(whole) == {"g0", "g1", "g2", None}
    for g, p in whole.items():
        v = np.sort([x for h, _, x, _ in rows if h == g and x is not None and x == x])
        want = [v[max(0, -(-q * len(v) // 100) - 1)] for q in (10, 50, 90)]
        assert np.allclose(p, want, rtol=2.0**-8, atol=1e-300)
    assert Q.digests(df.select("g", "value").limit(0), ["g"], "value").count() == 0


def test_large_groups_are_compressed_in_their_task(spark):
    df = spark.range(200_000).selectExpr("'x' AS g", "rand(1) * 1000 AS value")
    r = Q.digests(df, ["g"], "value", rank_error=0.05).first()
    assert sum(r["counts"]) == 200_000 and len(r["nodes"]) <= 3 * Q.BITS / 0.05
