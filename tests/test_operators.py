import json
import math

import pytest
from pyspark.sql import functions as F

from lumenq.functions import text
from lumenq.operators import filters, hybrid, knn, late, lexical, quantize, versions
from lumenq.sources.files import parse_byte_size

RECORDS = [("a", "rock", 1980, False), ("b", "rock", 2005, True), ("c", "jazz", 1999, False), ("d", "pop", 2020, True), ("e", "rock", 2015, False)]


@pytest.mark.parametrize(
    "spec,k,q,want",
    [
        ({"genre": "rock"}, 3, [0.0, 0.0], "abe"),
        ({"year": {"$gte": 2010}}, 2, [3.1, 0.0], "de"),
        ({"live": True}, 5, [0.0, 0.0], "bd"),
        ({"$and": [{"genre": {"$ne": "pop"}}, {"year": {"$lte": 2010}}]}, 3, [2.0, 0.0], "cba"),
    ],
)
def test_filtered_search(spark, spec, k, q, want):
    rows = [(i, [float(n), 0.0], json.dumps({"genre": g, "year": y, "live": v})) for n, (i, g, y, v) in enumerate(RECORDS)]
    df = spark.createDataFrame(rows, "id string, vector array<float>, meta string").withColumn("m", filters.parse_metadata(F.col("meta")))
    hits = knn.search(df, q, k, where=filters.compile_filter(spec, F.col("m"))).collect()
    assert "".join(h["id"] for h in hits) == want


def test_filter_kinds(spark):
    metas = ['{"a": 5, "n": null, "t": ["x", 1], "o": {"p": 1.5}}', '{"a": "5"}', "{}", None, "not json"]
    df = spark.createDataFrame(list(enumerate(metas)), "i int, meta string").withColumn("m", filters.parse_metadata(F.col("meta")))
    ids = lambda spec: sorted(r["i"] for r in df.where(filters.compile_filter(spec, F.col("m"))).collect())
    assert ids({"a": 5}) == [0] and ids({"a": "5"}) == [1] and ids({"a": {"$ne": 5}}) == [1, 2, 3, 4]
    assert ids({"a": {"$gt": "4"}}) == [1] and ids({"a": {"$gt": 4}}) == [0]
    assert ids({"n": {"$exists": True}}) == [0] and ids({"n": None}) == [0] and ids({"n": {"$exists": False}}) == [1, 2, 3, 4]
    assert ids({"t": {"$contains": 1}}) == [0] and ids({"t": {"$contains": "1"}}) == [] and ids({"o.p": {"$lte": 1.5}}) == [0]
    assert ids({"$and": []}) == [0, 1, 2, 3, 4] and ids({"$or": []}) == [] and ids({"a": {"$nin": [5]}}) == [1, 2, 3, 4]
    for bad in ([], {"a": {}}, {"a": {"$x": 1}}, {"$x": 1}, {"a": {"$regex": "("}}, {"$not": []}):
        with pytest.raises(ValueError):
            filters.compile_filter(bad, F.col("m"))


def test_tokenizers(spark):
    df = spark.createDataFrame([("Über-Maß 3x É_y", ), ("", ), (None, )], "t string")
    rows = df.select(text.tokenize(F.col("t")).alias("u"), text.tokenize(F.col("t"), "whitespace").alias("w"), text.tokenize(F.col("t"), "ngram:2").alias("g")).collect()
    assert rows[0]["u"] == ["über", "maß", "3x", "é", "y"] and rows[0]["w"] == ["Über-Maß", "3x", "É_y"] and rows[0]["g"][:2] == ["üb", "be"]
    assert rows[1]["u"] == [] and rows[1]["g"] == [] and rows[2]["u"] is None
    assert text.fnv1a_32(b"") == 2166136261 and text.fnv1a_32(b"a") == 0xE40C292C


def test_sparse_search(spark):
    s = "struct<indices:array<bigint>,values:array<float>>"
    docs = spark.createDataFrame([("a", ([5, 7], [1.0, 2.0])), ("b", ([5, 9], [3.0, 1.0])), ("c", None)], f"id string, sparse {s}")
    q = spark.createDataFrame([(1, ([5], [1.0]))], f"query_id int, sparse {s}")
    hits = lexical.search_sparse(docs, q, 5).collect()
    assert [(h["id"], h["distance"]) for h in hits] == [("b", -3.0), ("a", -1.0)]
    bad = spark.createDataFrame([("x", ([7, 5], [1.0, 1.0]))], f"id string, sparse {s}")
    with pytest.raises(Exception, match="bad sparse"):
        lexical.search_sparse(bad, q, 5).collect()
    assert lexical.search_sparse(bad, q, 5, strict=False).count() == 0


def test_maxsim_and_fusion(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[0.5, 0.0], [0.0, 3.0], [0.25, 0.25]])], "q array<array<float>>, d array<array<float>>")
    assert df.select(late.maxsim(F.col("q"), F.col("d"))).first()[0] == 6.5
    leg = lambda ids: spark.createDataFrame([(1, n + 1, i, float(n)) for n, i in enumerate(ids)], "query_id int, rank int, id string, distance double")
    legs = {"": leg("abcd"), "@text": leg("dbca")}
    hits = hybrid.fuse_rrf(legs, 4, 60).collect()
    assert [h["id"] for h in hits][0] in "ad" or hits
    assert {h["id"]: round(-h["distance"], 9) for h in hits}["b"] == round(2 / 61, 9)
    only = hybrid.fuse_weighted(legs, 4, {"@text": 0.0}, {"": "euclidean"}).collect()
    assert [h["id"] for h in only] == list("abcd")
    with pytest.raises(ValueError):
        hybrid.fuse_rrf({}, 3)


def test_k_and_rerank(spark):
    df = spark.createDataFrame([(c, [float(n)], n + 1) for n, c in enumerate("abcde")], "id string, vector array<float>, priority int")
    with pytest.raises(ValueError):
        knn.search(df, [0.0], 0)
    q = spark.createDataFrame([(1, [0.0])], "query_id int, vector array<float>")
    hits = knn.search_batch(df, q, 5)
    again = knn.rerank(hits.join(df.select("id", "priority"), "id"), F.col("priority"), 3).collect()
    assert [h["id"] for h in again] == ["e", "d", "c"]
    empty = df.limit(0)
    assert knn.search_batch(empty, q, 3).count() == 0 and knn.search_batch(df, q.limit(0), 3).count() == 0


def test_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", None), ("d", [1.0, 2.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(1, [0.0])], "query_id int, vector array<float>")
    assert [h["id"] for h in knn.search_batch(df, q, 5).collect()] == ["a", "b"]


def test_current_rows(spark):
    rows = [("x", "r", 2, None, "new"), ("x", "r", 1, 9, "old"), ("x", "r", 2, None, "new"), ("x", None, 1, 1, "void"), ("y", "r", None, None, None)]
    df = spark.createDataFrame(rows, "g string, r string, gen int, hlc int, p string")
    got = versions.current_rows(df, ["g", "r"], ["gen", "hlc"], ["p"]).collect()
    assert sorted((r["g"], r["p"]) for r in got) == [("x", "new"), ("y", None)]
    assert versions.current_rows(df.limit(0), ["g", "r"], ["gen"], ["p"]).count() == 0


def test_hadamard_and_sizes():
    import numpy as np

    x = np.random.default_rng(0).standard_normal((3, 8))
    assert np.allclose(quantize.hadamard(quantize.hadamard(x)), 8 * x)
    assert parse_byte_size("128MB") == 128_000_000 and parse_byte_size("1 GiB") == 2**30 and parse_byte_size(7) == 7
    with pytest.raises(ValueError):
        parse_byte_size("many")
    assert math.isclose(quantize.Srht(5).wide, 8)
