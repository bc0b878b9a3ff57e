"""Facades with the calls of other vector services over collections of this engine.

Scores are distances, smaller is better. Filters apply in every search, also to sparse and hybrid
ones. Results of single calls are small (k hits, or the wanted ids) and come back as Python objects.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from lumenq.compat import filters
from lumenq.index import Index
from lumenq.sources.collection import NotFound

PLAIN = "id string, vector array<float>, text string, metadata string"


class Store:
    """Named indexes below one folder."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def open(self, name: str) -> Index:
        return Index.open(self.spark, self.path(name))

    def exists(self, name: str) -> bool:
        try:
            self.open(name)
        except NotFound:
            return False
        return True

    def create(self, name: str, metric: str, dimensions: int) -> Index:
        return Index.create(self.spark, self.path(name), metric=metric, dimensions=dimensions, text=True)

    def names(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.uri)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def remove(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def put(index: Index, rows: list[tuple]) -> int:
    """Upserts (id, vector, metadata, text) rows."""
    data = [(str(i), None if v is None else [float(x) for x in v], t, None if m is None else json.dumps(m)) for i, v, m, t in rows]
    if data:
        index.upsert(index.spark.createDataFrame(data, PLAIN))
    return len(data)


def _ids(index: Index, ids: list) -> object:
    return index.spark.createDataFrame([(str(i),) for i in ids], "id string")


def _meta(text: str | None) -> dict:
    return json.loads(text) if text else {}


def _hits(index: Index, vector: list[float], k: int, where: dict | None) -> list[dict]:
    rows = index.search(vector, k, filter=where or None, include_metadata=True, include_vectors=True).collect()
    return [{"id": r["id"], "distance": r["distance"], "metadata": _meta(r["metadata"]), "vector": list(r["vector"])} for r in rows]


class PineconeIndex:
    def __init__(self, store: Store, metric: str, dimensions: int):
        self.store, self.metric, self.dimensions = store, filters.metric("pinecone", metric), dimensions

    def _space(self, namespace: str, make: bool = False) -> Index | None:
        name = namespace or "__default__"
        if not self.store.exists(name):
            return self.store.create(name, self.metric, self.dimensions) if make else None
        return self.store.open(name)

    def upsert(self, vectors: list, namespace: str = "") -> dict:
        rows = []
        for v in vectors:
            if isinstance(v, dict):
                rows.append((v["id"], v["values"], v.get("metadata"), None))
            else:
                rows.append((v[0], v[1], v[2] if len(v) > 2 else None, None))
        return {"upserted_count": put(self._space(namespace, True), rows)}

    def query(self, vector: list[float] | None = None, id: str | None = None, top_k: int = 10, namespace: str = "", filter: dict | None = None, include_values: bool = False, include_metadata: bool = False) -> dict:
        space = self._space(namespace)
        if space is None:
            return {"matches": [], "namespace": namespace}
        if vector is None:
            vector = space.get_vector(id)
            if vector is None:
                return {"matches": [], "namespace": namespace}
        out = [
            {"id": h["id"], "score": h["distance"], **({"values": h["vector"]} if include_values else {}), **({"metadata": h["metadata"]} if include_metadata else {})}
            for h in _hits(space, vector, top_k, filter)
        ]
        return {"matches": out, "namespace": namespace}

    def fetch(self, ids: list[str], namespace: str = "") -> dict:
        space = self._space(namespace)
        rows = space.get_records(ids) if space else []
        return {"namespace": namespace, "vectors": {r["id"]: {"id": r["id"], "values": list(r["vector"] or []), "metadata": _meta(r["metadata"])} for r in rows if r}}

    def delete(self, ids: list[str] | None = None, delete_all: bool = False, filter: dict | None = None, namespace: str = "") -> dict:
        space = self._space(namespace)
        if space is not None:
            gone = space.records(None if delete_all else filter).select("id") if ids is None else _ids(space, ids)
            if ids is None and not delete_all and filter is None:
                raise ValueError("delete needs ids, a filter or delete_all")
            space.delete(gone)
        return {}

    def list_paginated(self, prefix: str = "", limit: int = 100, pagination_token: str | None = None, namespace: str = "") -> dict:
        space = self._space(namespace)
        if space is None:
            return {"vectors": [], "pagination": None, "namespace": namespace}
        rows = space.records().select("id")
        rows = rows.where(rows["id"].startswith(prefix)) if prefix else rows
        rows = rows.where(rows["id"] > pagination_token) if pagination_token else rows
        ids = [r["id"] for r in rows.orderBy("id").limit(limit + 1).collect()]
        return {"vectors": [{"id": i} for i in ids[:limit]], "pagination": {"next": ids[limit - 1]} if len(ids) > limit else None, "namespace": namespace}

    def list(self, **how: object):  # noqa: ANN201
        token = None
        while True:
            page = self.list_paginated(pagination_token=token, **how)
            yield [v["id"] for v in page["vectors"]]
            if not page["pagination"]:
                return
            token = page["pagination"]["next"]

    def describe_index_stats(self) -> dict:
        spaces = {n: {"vector_count": self.store.open(n).stats().first()["records"]} for n in self.store.names()}
        return {"dimension": self.dimensions, "namespaces": spaces, "total_vector_count": sum(s["vector_count"] for s in spaces.values())}


class Pinecone:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri, self._made = spark, uri.rstrip("/"), {}

    def create_index(self, name: str, dimension: int, metric: str = "cosine") -> None:
        filters.metric("pinecone", metric)
        self._made[name] = (metric, dimension)

    def Index(self, name: str) -> PineconeIndex:  # noqa: N802
        metric, dims = self._made[name]
        return PineconeIndex(Store(self.spark, f"{self.uri}/{name}"), metric, dims)


class QdrantClient:
    def __init__(self, spark: SparkSession, uri: str):
        self.store = Store(spark, uri)

    def create_collection(self, name: str, size: int, distance: str = "Cosine") -> bool:
        self.store.create(name, filters.metric("qdrant", distance), size)
        return True

    def recreate_collection(self, name: str, size: int, distance: str = "Cosine") -> bool:
        self.store.remove(name)
        return self.create_collection(name, size, distance)

    def collection_exists(self, name: str) -> bool:
        return self.store.exists(name)

    def upsert(self, name: str, points: list) -> int:
        rows = [filters.plain(p) for p in points]
        return put(self.store.open(name), [(r.get("id"), r.get("vector"), r.get("payload"), None) for r in rows])

    def search(self, name: str, query_vector: list[float], limit: int = 10, query_filter: object = None, offset: int = 0) -> list[dict]:
        hits = _hits(self.store.open(name), query_vector, limit + offset, filters.condition_filter(query_filter))
        return [{"id": h["id"], "score": h["distance"], "payload": h["metadata"], "vector": h["vector"]} for h in hits[offset:]]

    query_points = search

    def retrieve(self, name: str, ids: list) -> list[dict]:
        rows = self.store.open(name).get_records([str(i) for i in ids])
        return [{"id": r["id"], "payload": _meta(r["metadata"]), "vector": list(r["vector"] or [])} for r in rows if r]

    def scroll(self, name: str, limit: int = 10, offset: str | None = None, scroll_filter: object = None) -> tuple[list[dict], str | None]:
        rows = self.store.open(name).records(filters.condition_filter(scroll_filter))
        rows = rows.where(rows["id"] >= offset) if offset else rows
        got = rows.orderBy("id").limit(limit + 1).collect()
        return [{"id": r["id"], "payload": _meta(r["metadata"])} for r in got[:limit]], got[limit]["id"] if len(got) > limit else None

    def delete(self, name: str, points: list) -> int:
        index = self.store.open(name)
        return index.delete(_ids(index, points))

    def count(self, name: str) -> int:
        return self.store.open(name).records().count()


class S3Vectors:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self._buckets: set[str] = set()

    def _store(self, bucket: str) -> Store:
        return Store(self.spark, f"{self.uri}/{bucket}")

    def create_vector_bucket(self, vectorBucketName: str) -> dict:  # noqa: N803
        self._buckets.add(vectorBucketName)
        return {}

    def list_vector_buckets(self) -> dict:
        return {"vectorBuckets": [{"vectorBucketName": b} for b in sorted(self._buckets | set(Store(self.spark, self.uri).names()))]}

    def create_index(self, vectorBucketName: str, indexName: str, dimension: int, distanceMetric: str = "cosine") -> dict:  # noqa: N803
        self._store(vectorBucketName).create(indexName, filters.metric("s3vectors", distanceMetric), dimension)
        return {}

    def list_indexes(self, vectorBucketName: str) -> dict:  # noqa: N803
        return {"indexes": [{"indexName": n} for n in self._store(vectorBucketName).names()]}

    def get_index(self, vectorBucketName: str, indexName: str) -> dict:  # noqa: N803
        spec = self._store(vectorBucketName).open(indexName).spec
        return {"index": {"indexName": indexName, "dimension": spec.dimensions, "distanceMetric": spec.metric}}

    def put_vectors(self, vectorBucketName: str, indexName: str, vectors: list[dict]) -> dict:  # noqa: N803
        put(self._store(vectorBucketName).open(indexName), [(v["key"], v["data"]["float32"], v.get("metadata"), None) for v in vectors])
        return {}

    def query_vectors(self, vectorBucketName: str, indexName: str, queryVector: dict, topK: int = 10, filter: dict | None = None) -> dict:  # noqa: N803
        hits = _hits(self._store(vectorBucketName).open(indexName), queryVector["float32"], topK, filter)
        return {"vectors": [{"key": h["id"], "distance": h["distance"], "metadata": h["metadata"]} for h in hits]}

    def get_vectors(self, vectorBucketName: str, indexName: str, keys: list[str]) -> dict:  # noqa: N803
        rows = self._store(vectorBucketName).open(indexName).get_records(keys)
        return {"vectors": [{"key": r["id"], "data": {"float32": list(r["vector"] or [])}, "metadata": _meta(r["metadata"])} for r in rows if r]}

    def delete_vectors(self, vectorBucketName: str, indexName: str, keys: list[str]) -> dict:  # noqa: N803
        index = self._store(vectorBucketName).open(indexName)
        index.delete(_ids(index, keys))
        return {}


class TurbopufferNamespace:
    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name

    def write(self, upsert_rows: list[dict] | None = None, deletes: list | None = None, distance_metric: str = "cosine_distance") -> int:
        rows = upsert_rows or []
        if not self.store.exists(self.name):
            if not rows:
                return 0
            self.store.create(self.name, filters.metric("turbopuffer", distance_metric), len(rows[0]["vector"]))
        index = self.store.open(self.name)
        n = put(index, [(r["id"], r["vector"], {k: v for k, v in r.items() if k not in ("id", "vector")}, None) for r in rows])
        return n + (index.delete(_ids(index, deletes)) if deletes else 0)

    def query(self, vector: list[float], top_k: int = 10, filters_: object = None) -> list[dict]:
        hits = _hits(self.store.open(self.name), vector, top_k, filters.list_filter(filters_))
        return [{"id": h["id"], "$dist": h["distance"], **h["metadata"]} for h in hits]


class Turbopuffer:
    def __init__(self, spark: SparkSession, uri: str):
        self.store = Store(spark, uri)

    def namespace(self, name: str) -> TurbopufferNamespace:
        return TurbopufferNamespace(self.store, name)


class ChromaCollection:
    def __init__(self, index: Index, name: str):
        self.index, self.name = index, name

    def upsert(self, ids: list[str], embeddings: list, metadatas: list | None = None, documents: list | None = None) -> None:
        n = len(ids)
        put(self.index, list(zip(ids, embeddings, metadatas or [None] * n, documents or [None] * n)))

    def add(self, ids: list[str], embeddings: list, metadatas: list | None = None, documents: list | None = None) -> None:
        n = len(ids)
        data = [(i, [float(x) for x in v], d, json.dumps(m) if m else None) for i, v, m, d in zip(ids, embeddings, metadatas or [None] * n, documents or [None] * n)]
        self.index.add(self.index.spark.createDataFrame(data, PLAIN))

    def query(self, query_embeddings: list, n_results: int = 10, where: dict | None = None) -> dict:
        every = [_hits(self.index, v, n_results, where) for v in query_embeddings]
        pick = lambda key: [[h[key] for h in hits] for hits in every]
        return {"ids": pick("id"), "distances": pick("distance"), "metadatas": pick("metadata")}

    def get(self, ids: list[str] | None = None, where: dict | None = None, limit: int | None = None) -> dict:
        rows = self.index.records(where)
        rows = rows.join(_ids(self.index, ids), "id", "left_semi") if ids is not None else rows
        rows = rows.orderBy("id")
        got = (rows.limit(limit) if limit is not None else rows).collect()
        return {"ids": [r["id"] for r in got], "metadatas": [_meta(r["metadata"]) for r in got], "documents": [r["text"] for r in got]}

    def peek(self, limit: int = 10) -> dict:
        return self.get(limit=limit)

    def delete(self, ids: list[str] | None = None, where: dict | None = None) -> None:
        if where is not None or ids is None:
            raise ValueError("delete by ids only")
        self.index.delete(_ids(self.index, ids))
        self.index.purge()

    def count(self) -> int:
        return self.index.records().count()


class Chroma:
    def __init__(self, spark: SparkSession, uri: str, dimensions: int):
        self.store, self.dimensions = Store(spark, uri), dimensions

    def create_collection(self, name: str, space: str = "l2") -> ChromaCollection:
        return ChromaCollection(self.store.create(name, filters.metric("chroma", space), self.dimensions), name)

    def get_collection(self, name: str) -> ChromaCollection:
        return ChromaCollection(self.store.open(name), name)

    def get_or_create_collection(self, name: str, space: str = "l2") -> ChromaCollection:
        return self.get_collection(name) if self.store.exists(name) else self.create_collection(name, space)

    def delete_collection(self, name: str) -> None:
        self.store.remove(name)


class TextStore:
    """A vector store over texts, with an embedding function from texts to vectors."""

    def __init__(self, index: Index, embed):  # noqa: ANN001
        self.index, self.embed = index, embed

    def add_texts(self, texts: list[str], metadatas: list[dict] | None = None, ids: list[str] | None = None) -> list[str]:
        import uuid

        ids = ids or [uuid.uuid4().hex for _ in texts]
        put(self.index, list(zip(ids, self.embed(texts), metadatas or [{}] * len(texts), texts)))
        return ids

    def similarity_search_with_score(self, query: str, k: int = 4, filter: dict | None = None) -> list[tuple[str, float]]:
        hits = _hits(self.index, self.embed([query])[0], k, filter)
        texts = {r["id"]: r["text"] for r in self.index.get_records([h["id"] for h in hits]) if r}
        return [(texts[h["id"]], h["distance"]) for h in hits]

    def similarity_search(self, query: str, k: int = 4, filter: dict | None = None) -> list[str]:
        return [t for t, _ in self.similarity_search_with_score(query, k, filter)]

    def delete(self, ids: list[str]) -> bool:
        return self.index.delete(_ids(self.index, ids)) > 0
