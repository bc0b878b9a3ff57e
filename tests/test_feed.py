import pytest
from pyspark.sql import functions as F

from lumenq.sources import collection, files
from lumenq.streaming import feed, ingest
from lumenq.util import scratch_path

SCHEMA = "feed_offset bigint, ns string, hlc bigint, writer string, upsert_rows array<struct<id:string,payload_key:string>>, deletes array<string>, ns2 string"


def write(rows):
    return [(n, *r, "x") for n, r in enumerate(rows)]


BATCHES = [
    write([("n", 5, "AB", [("a", "5ab"), ("a", "5ab2"), (None, "void"), ("", "void")], ["a"]), ("n", 3, "ff", [("a", "late")], None)]),
    write([("n", 5, "ac", [("b", "5ac")], None), ("n", 6, "00", None, ["b", None, ""]), (None, 1, "00", [("z", None)], [])]),
    write([("n", 5, "ac", [("b", "5ac")], None), ("n", None, None, [("c", "bare")], None), ("m", 1, "00", [("a", "other")], ["q"])]),
]
WANT = {("n", "a", "5ab2"), ("n", "c", "bare"), ("m", "a", "other"), (None, "z", None)}


def test_stream_over_batches(spark):
    path = scratch_path(spark, "in")
    schema = spark.createDataFrame([], SCHEMA).schema
    table = feed.ChangeTable(spark, scratch_path(spark, "feed"), ["ns", "id"])
    for n, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        table.run(feed.flatten_writes(feed.stream_of(spark, path, schema, 1), ["payload_key"]))
        assert table.versions().select("version").distinct().count() >= n + 1
    got = {(r["ns"], r["id"], r["payload_key"]) for r in table.live().collect()}
    assert got == WANT
    # the same in one batch, and another order of arrival
    every = spark.createDataFrame([r for b in reversed(BATCHES) for r in reversed(b)], schema)
    once = feed.newest(feed.flatten_writes(every, ["payload_key"]), ["ns", "id"]).where("NOT tombstone")
    assert {(r["ns"], r["id"], r["payload"]["payload_key"]) for r in once.collect()} == WANT
    # writing a batch again changes nothing
    table.write(table.versions().where("version = 0").drop("version").persist(), 99)
    assert feed.newest(feed.flatten_writes(every.limit(0), ["payload_key"]), ["ns", "id"]).count() == 0


def test_collection(spark):
    path = scratch_path(spark, "c")
    make = lambda rows: spark.createDataFrame(rows, "id string, vector array<float>, text string")
    c = collection.Collection.create(spark, path, collection.Spec("euclidean", 2, text=True))
    with pytest.raises(collection.AlreadyExists):
        collection.Collection.create(spark, path, collection.Spec("euclidean", 2))
    c.add(make([("a", [1.0, 2.0], "x"), ("b", [3.0, 4.0], None)]))
    before = c.version
    with pytest.raises(collection.DuplicateRecordId):
        c.add(make([("a", [1.0, 2.0], None)]))
    for bad in (("", [1.0, 2.0], None), ("q", [1.0], None), ("q", [float("nan"), 1.0], None)):
        with pytest.raises(collection.InvalidRecord):
            c.upsert(make([bad]))
    c.upsert(make([("b", [9.0, 9.0], None), ("c", None, "only text")]))
    assert c.delete(make([("a", None, None), ("a", None, None), ("zz", None, None)]).select("id")) == 1
    with pytest.raises(collection.DuplicateRecordId):
        c.add(make([("a", [1.0, 2.0], None)]))
    live = {r["id"]: r["vector"] for r in c.live().collect()}
    assert live == {"b": [9.0, 9.0], "c": None}
    assert {r["id"] for r in collection.Collection(spark, path, before).live().collect()} == {"a", "b"}
    c.compact()
    s = c.stats().first()
    assert (s["records"], s["tombstones"], s["texts"]) == (2, 1, 1)
    c.purge()
    c.add(make([("a", [1.0, 2.0], None)]))
    assert c.refresh().live().count() == 3
    assert c.gc() == [] and len(c.gc(dry_run=False, min_age_seconds=0)) >= 4
    assert c.live().count() == 3
    ids = c.add_vectors(make([(None, [5.0, 5.0], None)]).select("vector")).collect()
    assert ids[0]["id"].startswith("g") and len(ids[0]["id"]) == 65


def test_ingest_is_idempotent(spark):
    path = scratch_path(spark, "c")
    c = collection.Collection.create(spark, path, collection.Spec("euclidean", 1))
    src = scratch_path(spark, "src")
    schema = "id string, vector array<float>, text string, metadata string, op string, seq bigint"
    rows = [("a", [1.0], None, None, "put", 1), ("a", [2.0], None, None, "put", 2), ("b", [1.0], None, None, "put", 1), ("b", None, None, None, "delete", 2)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(src)
    ingest.ingest(feed.stream_of(spark, src, df.schema), c, scratch_path(spark, "k")).awaitTermination()
    assert [(r["id"], r["vector"]) for r in c.refresh().live().collect()] == [("a", [2.0])]
    c.refresh().apply(df.where("id = 'b' AND op = 'put'"), 0, next(iter(c.refresh()._state["batches"])))  # batch 0 again
    assert c.refresh().live().count() == 1


def test_late_changes_and_two_streams(spark):
    path = scratch_path(spark, "c")
    collection.Collection.create(spark, path, collection.Spec("euclidean", 1))
    schema = "id string, vector array<float>, text string, metadata string, op string, seq bigint"
    src = scratch_path(spark, "src")
    check = scratch_path(spark, "k")
    apply = lambda rows, number, k=check, at=src: (
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at),
        ingest.ingest(feed.stream_of(spark, at, spark.read.schema(schema).parquet(at).schema), collection.Collection(spark, path), k).awaitTermination(),
    )
    apply([("a", [10.0], None, None, "put", 10), ("d", None, None, None, "delete", 9)], 0)
    apply([("a", [5.0], None, None, "put", 5), ("b", [6.0], None, None, "put", 6), ("d", [1.0], None, None, "put", 8)], 1)  # a and d come late
    live = lambda: {r["id"]: r["vector"] for r in collection.Collection(spark, path).live().collect()}
    assert live() == {"a": [10.0], "b": [6.0]}
    apply([("c", [1.0], None, None, "put", 1), ("b", None, None, None, "delete", 5)], 0, scratch_path(spark, "k"), scratch_path(spark, "src"))  # a second stream's batch 0
    assert live() == {"a": [10.0], "b": [6.0], "c": [1.0]}
    collection.Collection(spark, path).compact()
    apply([("a", [7.0], None, None, "put", 7), ("b", [8.0], None, None, "put", 8)], 2)
    assert live() == {"a": [10.0], "b": [8.0], "c": [1.0]}


def test_two_writers_and_snapshots(spark):
    path = scratch_path(spark, "c")
    row = lambda i, x: spark.createDataFrame([(i, [x])], "id string, vector array<float>")
    one = collection.Collection.create(spark, path, collection.Spec("euclidean", 1))
    two = collection.Collection(spark, path)
    one.upsert(row("a", 1.0))
    two.upsert(row("b", 2.0))  # opened before a was written
    assert {r["id"] for r in two.live().collect()} == {"a", "b"} and (one.version, two.version) == (1, 2)
    old = collection.Collection(spark, path, 1)
    with pytest.raises(collection.ReadOnly):
        old.upsert(row("c", 3.0))
    raced = collection.Collection(spark, path)
    inner = raced._puts

    def slow(records):
        raced._puts = inner
        one.upsert(row("c", 3.0))  # another writer takes the version in between
        return inner(records)

    raced._puts = slow
    raced.upsert(row("d", 4.0))
    assert {r["id"] for r in one.refresh().live().collect()} == {"a", "b", "c", "d"} and raced.version == 4
    with pytest.raises(collection.NotFound):
        collection.Collection(spark, path, 99)


def test_json_records(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('[{"id": "a", "vector": [1, 2], "metadata": {"x": 1}, "named_vectors": {"d": [1], "l": [[1, 2], [3, 4]]}}, {"id": "b"}]')
    rows = {r["id"]: r for r in files.read_json(spark, str(p), {"d": "dense", "l": "late"}).collect()}
    assert rows["a"]["vector"] == [1.0, 2.0] and rows["a"]["named"] == {"d": [1.0]} and rows["a"]["multi"]["l"] == [[1, 2], [3, 4]]
    assert rows["a"]["metadata"] == '{"x":1}' or rows["a"]["metadata"] == '{"x": 1}'
    assert rows["b"]["vector"] is None and F is not None
