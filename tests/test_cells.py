import numpy as np
import pytest

from lumenq.operators import ivf, knn, maintain
from lumenq.operators.options import RecallNotGuaranteed, SearchOptions, search


@pytest.fixture(scope="module")
def index(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((5, 6)) * 5
    rows = [(f"i{n:03}", (centres[n % 5] + rng.standard_normal(6)).tolist()) for n in range(300)] + [("none", None)]
    return ivf.build(spark.createDataFrame(rows, "id string, vector array<double>"), "euclidean", cells=12)


def asked(index):
    return index.records.where("id < 'i020'").selectExpr("id AS query_id", "vector")


def ids(hits):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in hits.collect())


def test_modes(index):
    want = ids(knn.search_batch(index.records, asked(index), 5))
    hits, report = search(index, asked(index), SearchOptions(5, "exact", guaranteed_recall=True))
    assert ids(hits) == want and report["recall_guarantee"] == "exact"
    for o, reason in (
        (SearchOptions(5, max_segments=3), "max-segments"),
        (SearchOptions(5, max_bytes=6 * 4 * 150), "max-bytes"),
        (SearchOptions(5, "exact", eps=0.0), "epsilon"),
        (SearchOptions(5, max_segments=12, max_candidates_per_segment=30), "max-segments"),
        (SearchOptions(5, leaf_mode="graph"), "complete"),
        (SearchOptions(5, leaf_mode="hybrid"), "complete"),
    ):
        hits, report = search(index, asked(index), o)
        got = ids(hits)
        assert report["termination"] == reason and report["recall_guarantee"] != "exact"
        assert len({(q, i) for q, _, i in got} & {(q, i) for q, _, i in want}) >= 0.6 * len(want), o
    eps0, _ = search(index, asked(index), SearchOptions(5, "exact", eps=0.0))
    assert ids(eps0) == want
    for bad in (SearchOptions(0), SearchOptions(5, "other"), SearchOptions(5, eps=-1.0), SearchOptions(5, max_segments=0), SearchOptions(5, leaf_mode="x")):
        with pytest.raises(ValueError):
            bad.checked()
    with pytest.raises(RecallNotGuaranteed):
        SearchOptions(5, "exact", max_segments=3, guaranteed_recall=True).checked()


def test_maintenance(index):
    split, merge = maintain.plan(index, most=40, least=15)
    new = maintain.maintain(index, most=40, least=15)
    assert split or merge
    assert new.records.count() == index.records.count() == 300
    assert len(new.centroids) == len(index.centroids) + len(split) - len(merge)
    assert ids(ivf.search_pruned(new, asked(index), 5)) == ids(knn.search_batch(index.records, asked(index), 5))
    assert maintain.maintain(index, most=100_000, least=0) is index and maintain.imbalance(new) >= 1
    with pytest.raises(ValueError):
        maintain.plan(index, most=10, least=9)


@pytest.mark.parametrize("metric", ["cosine", "angular", "manhattan", "gower", "chebyshev", "minkowski:3"])
def test_pruned_is_exact(spark, metric):
    rng = np.random.default_rng(3)
    rows = [(f"i{n:03}", (rng.standard_normal(4) + (n % 3)).tolist()) for n in range(150)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    q = df.where("id < 'i010'").selectExpr("id AS query_id", "vector")
    assert ids(ivf.search_pruned(ivf.build(df, metric, cells=9), q, 4)) == ids(knn.search_batch(df, q, 4, metric))


def test_bounding_boxes(index):
    r = ivf.bounding_boxes(index).collect()
    assert all(all(a <= b for a, b in zip(x["low"], x["high"])) and len(x["low"]) == 6 for x in r)
