import json

import pytest
from pyspark.sql import functions as F

from lumenq.__main__ import run
from lumenq.compat import filters, services
from lumenq.index import Index
from lumenq.sources.collection import InvalidRecord, NotFound
from lumenq.util import scratch_path


def test_index(spark):
    index = Index.create(spark, scratch_path(spark, "i"), dimensions=2, text=True)
    rows = [("a", [0.0, 0.0], "red apple", {"c": 1}), ("b", [1.0, 0.0], "green apple pie", {"c": 2}), ("c", [5.0, 0.0], None, None)]
    services.put(index, [(i, v, m, t) for i, v, t, m in rows])
    assert index.search_ids([0.1, 0.0], 2) == ["a", "b"] and index.search_ids([0.0, 0.0], 5, filter={"c": {"$gte": 2}}) == ["b"]
    assert index.search_vectors([4.0, 0.0], 1) == [[5.0, 0.0]] and index.get_vector("zz") is None
    assert [r and r["id"] for r in index.get_records(["c", "zz", "c"])] == ["c", None, "c"]
    hits, seen = index.search_with_report([0.0, 0.0], 1, filter={"c": 1})
    assert hits[0]["id"] == "a" and seen["rows_passed_filter"] == 1 and seen["records_considered"] == 3
    q = spark.createDataFrame([(1, [0.0, 0.0], "pie")], "query_id int, vector array<float>, text string")
    assert [h["id"] for h in index.search_text(q.select("query_id", "text"), 5).collect()] == ["b"]
    assert index.search_hybrid(q, 3).first()["id"] == "b"
    assert index.search_hybrid(q, 3, weights={"@text": 0}).first()["id"] == "a"
    assert index.search_batch(q.select("query_id", "vector"), 2, mode="scalar-bounds").count() == 2
    assert "TakeOrderedAndProject" in index.explain([0.0, 0.0], 2) and [r["id"] for r in index.list_records(1, 1).collect()] == ["b"]
    with pytest.raises(ValueError):
        index.search([1.0], 3)
    with pytest.raises(ValueError):
        index.search_hybrid(q.select("query_id"), 3)


NAMED = {"d": {"kind": "dense", "metric": "euclidean", "dimensions": 1}, "s": {"kind": "sparse"}, "l": {"kind": "late", "dimensions": 2}}


def test_named_vectors(spark, tmp_path):
    uri = scratch_path(spark, "named")
    do = lambda *argv: run(spark, [argv[0], uri, *argv[1:]])
    do("create", "--dimensions", "10", "--named", json.dumps(NAMED))
    p = tmp_path / "r.json"
    records = [
        {"id": "a", "sparse": {"indices": [5, 7], "values": [1, 2]}, "named_vectors": {"d": [1], "s": {"indices": [5, 7], "values": [1, 2]}, "l": [[1, 0], [0, 3]]}},
        {"id": "b", "vector": [0] * 10, "named_vectors": {"s": {"indices": [5, 9], "values": [3, 1]}, "l": [[0.5, 0]]}},
        {"id": "c", "named_vectors": {"d": [4]}},
    ]
    p.write_text(json.dumps(records))
    do("add", str(p))
    index = Index.open(spark, uri)
    assert index.get_vector("a") == [0, 0, 0, 0, 0, 1, 0, 2, 0, 0]
    assert [r["id"] for r in do("search-sparse-named", "--name", "s", "--query", '{"indices": [5], "values": [1]}')] == ["b", "a"]
    assert [(r["id"], r["distance"]) for r in do("search-late-interaction", "--name", "l", "--query", "[[1, 0], [0, 2]]")] == [("a", -7.0), ("b", -0.5)]
    q = spark.createDataFrame([(0, {"d": [3.5]}, {"l": [[1.0, 0.0]]})], "query_id int, named map<string, array<float>>, multi map<string, array<array<float>>>")
    assert [r["id"] for r in index.search_named("d", q.selectExpr("query_id", "named['d'] AS vector"), 5).collect()] == ["c", "a"]
    assert {r["id"] for r in index.search_hybrid(q, 5).collect()} == {"a", "b", "c"}
    index.upsert(spark.createDataFrame([("c", {"d": [0.0]})], "id string, named map<string, array<float>>"))
    index.compact()
    assert [r["id"] for r in index.search_named("d", q.selectExpr("query_id", "named['d'] AS vector"), 5).collect()] == ["a", "c"]
    for bad in ({"d": [1.0, 2.0]}, {"x": [1.0]}, {"d": [float("nan")]}):
        with pytest.raises(InvalidRecord):
            index.upsert(spark.createDataFrame([("e", bad)], "id string, named map<string, array<float>>"))
    with pytest.raises(NotFound):
        index.collection.vectors_of("x")


def passing(spark, test):
    data = [("a", '{"g": "x", "y": 1, "z": [1, 2], "s": "Red apple pie"}'), ("b", '{"g": "y", "y": 5, "z": [], "n": null, "o": [{"p": 1}, {"p": 2}]}'), ("c", None), ("d", '{"g": "xy", "at": [48.0, 11.0]}')]
    df = spark.createDataFrame(data, "id string, metadata string")
    return "".join(sorted(r["id"] for r in df.where(test(F.try_parse_json("metadata"), F.col("id"))).collect()))


def test_list_filters(spark):
    on = lambda f: passing(spark, filters.list_filter(f))
    assert on(("And", (("g", "Eq", "x"), ("Not", ("y", "In", [5]))))) == "a"
    assert on(["Or", [["y", "Gte", 5], ["z", "ContainsAny", [2, 9]]]]) == "ab" and on(["g", "NotEq", "x"]) == "bcd"
    assert on(["g", "Glob", "x*"]) == "ad" and on(["g", "NotGlob", "X*"]) == "abcd" and on(["g", "IGlob", "X?"]) == "d" and on(["y", "NotIn", [1]]) == "bcd"
    assert filters.list_filter(None) is None
    for bad in (("g", "Near", 1), (), "x"):
        with pytest.raises(ValueError):
            filters.list_filter(bad)
    with pytest.raises(ValueError):
        filters.metric("qdrant", "cosine")


def test_condition_filters(spark):
    on = lambda **f: passing(spark, filters.condition_filter(f))
    field = lambda key, **how: {"key": key, **how}
    assert on(must=[field("g", match={"value": "x"})], must_not=[field("y", range={"lt": 0})], should=[field("z", match={"any": [1]})]) == "a"
    assert on(must=field("z", match={"value": 2})) == "a" and on(must=[field("g", match={"except": ["x"]})]) == "bd"
    assert on(must=[{"has_id": ["b", "c"]}]) == "bc" and on(must=[{"is_null": {"key": "n"}}]) == "b" and on(must=[{"is_empty": {"key": "z"}}]) == "bcd"
    assert on(must=[field("z", values_count={"gte": 2})]) == "a" and on(must=[field("s", match={"text": "PIE red"})]) == "a" and on(must=[field("s", match={"text": "app"})]) == ""
    assert on(must=[{"nested": {"key": "o", "filter": {"must": [field("p", match={"value": 2})]}}}]) == "b"
    assert on(min_should={"conditions": [field("g", match={"value": "x"}), field("y", range={"gt": 0}), {"has_id": ["d"]}], "min_count": 2}) == "a"
    assert on(must=[field("at", geo_radius={"center": {"lat": 48.1, "lon": 11.0}, "radius": 20_000})]) == "d"
    assert filters.condition_filter({"a": 1}) == {"a": 1} and filters.condition_filter(None) is None
    with pytest.raises(ValueError):
        filters.condition_filter({"must": [{"key": "g"}]})


def test_services(spark):
    p = services.Pinecone(spark, scratch_path(spark, "p"))
    p.create_index("x", 2, "euclidean")
    i = p.Index("x")
    assert i.query([0, 0])["matches"] == []
    i.upsert([("a", [0, 0], {"g": 1}), {"id": "b", "values": [3, 4]}], namespace="n")
    assert [m["id"] for m in i.query([0, 1], top_k=5, namespace="n")["matches"]] == ["a", "b"]
    assert i.query(id="b", top_k=1, namespace="n", include_values=True)["matches"][0]["values"] == [3.0, 4.0]
    assert i.describe_index_stats()["total_vector_count"] == 2 and list(i.list(namespace="n", limit=1)) == [["a"], ["b"]]
    i.delete(filter={"g": 1}, namespace="n")
    assert set(i.fetch(["a", "b"], namespace="n")["vectors"]) == {"b"}
    q = services.QdrantClient(spark, scratch_path(spark, "q"))
    q.create_collection("c", 2, "Euclid")
    q.upsert("c", [{"id": n, "vector": [n, 0], "payload": {"n": n}} for n in range(4)])
    assert [h["id"] for h in q.search("c", [0, 0], 2, {"must": [{"key": "n", "range": {"gte": 1}}]})] == ["1", "2"]
    assert q.scroll("c", 2)[1] == "2" and q.count("c") == 4 and q.delete("c", [1, 9]) == 1 and len(q.retrieve("c", [1, 2])) == 1
    q.recreate_collection("c", 3)
    assert q.count("c") == 0 and q.collection_exists("c") and not q.collection_exists("d")
    s = services.S3Vectors(spark, scratch_path(spark, "s"))
    s.create_index("b", "i", 1, "euclidean")
    s.put_vectors("b", "i", [{"key": "k", "data": {"float32": [2]}, "metadata": {"m": 1}}])
    assert s.query_vectors("b", "i", {"float32": [0]})["vectors"] == [{"key": "k", "distance": 2.0, "metadata": {"m": 1}}]
    assert s.list_indexes("b")["indexes"] == [{"indexName": "i"}] and s.get_vectors("b", "i", ["k", "z"])["vectors"][0]["key"] == "k"
    t = services.Turbopuffer(spark, scratch_path(spark, "t")).namespace("n")
    t.write([{"id": 1, "vector": [1, 0], "g": "x"}, {"id": 2, "vector": [0, 1], "g": "y"}], distance_metric="cosine_distance")
    assert [h["id"] for h in t.query([1, 0], 2, ("g", "Eq", "y"))] == ["2"] and t.write(deletes=[1]) == 1
    c = services.Chroma(spark, scratch_path(spark, "c"), 1).get_or_create_collection("x")
    c.add(["a", "b"], [[1], [2]], [{"v": 1}, {"v": 2}], ["one", "two"])
    assert c.query([[1.9]], 1)["ids"] == [["b"]] and c.get(where={"v": 1})["documents"] == ["one"] and c.count() == 2
    c.delete(["a"])
    c.add(["a"], [[1]])
    assert c.peek(1)["ids"] == ["a"]
    with pytest.raises(ValueError):
        c.delete(where={"v": 1})
    x = services.TextStore(Index.create(spark, scratch_path(spark, "x"), dimensions=1, text=True), lambda ts: [[float(len(v))] for v in ts])
    x.add_texts(["a", "abc"])
    assert x.similarity_search("ab!!", 1) == ["abc"]


def test_command_line(spark, tmp_path):
    uri = scratch_path(spark, "cli")
    (tmp_path / "r.json").write_text(json.dumps([{"id": "a", "vector": [0, 1], "text": "hello there", "metadata": {"n": 1}}, {"id": "b", "vector": [5, 5], "text": "bye"}]))
    run(spark, ["create", uri, "--dimensions", "2", "--text"])
    run(spark, ["add", uri, str(tmp_path / "r.json")])
    assert run(spark, ["search", uri, "--vector", "[0,0]", "-k", "1"])[0]["id"] == "a"
    assert run(spark, ["search-text", uri, "--text", "bye"])[0]["id"] == "b"
    assert run(spark, ["search-hybrid", uri, "--text", "hello", "--vector", "[0,1]"])[0]["id"] == "a"
    assert run(spark, ["delete", uri, "a", "zz"]) == [{"deleted": 1}]
    assert run(spark, ["stats", uri])[0]["tombstones"] == 1
    run(spark, ["compact", uri])
    run(spark, ["purge", uri])
    assert [r["id"] for r in run(spark, ["list", uri])] == ["b"] and run(spark, ["gc", uri]) == [{"folders": []}]
