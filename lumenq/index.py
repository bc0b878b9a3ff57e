"""One object for a collection and the searches over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.functions import metrics
from lumenq.operators import explain, filters, hybrid, ivf, knn, late, lexical, quantize
from lumenq.sources.collection import KINDS, Collection, Spec


class Index:
    """A collection with search; every search returns a DataFrame of hits."""

    def __init__(self, collection: Collection):
        self.collection = collection
        self.spark = collection.spark
        self.spec = collection.spec

    @classmethod
    def create(cls, spark: SparkSession, path: str, *, metric: str = "euclidean", dimensions: int, text: bool = False, element_type: str = "float32", tokenizer: str = "unicode", named: dict[str, dict] | None = None) -> Index:
        return cls(Collection.create(spark, path, Spec(metric, dimensions, element_type, text, tokenizer, named or {})))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(Collection(spark, path))

    def records(self, filter: dict | str | None = None) -> DataFrame:
        """The live records that a metadata filter lets through: one of this engine, or a function of the
        metadata and id columns."""
        live = self.collection.live()
        if filter is None:
            return live
        test = filter if callable(filter) else lambda m, i: filters.compile_filter(filter, m)
        return live.withColumn("__m", filters.parse_metadata(F.col("metadata"))).where(test(F.col("__m"), F.col("id"))).drop("__m")

    def search(self, vector: list[float], k: int = 10, *, filter: dict | str | None = None, include_metadata: bool = False, include_vectors: bool = False) -> DataFrame:
        """Exact: id, distance, and metadata or vector when asked for."""
        if len(vector) != self.spec.dimensions:
            raise ValueError(f"the query has {len(vector)} dimensions, the index {self.spec.dimensions}")
        keep = [c for c, on in (("metadata", include_metadata), ("vector", include_vectors)) if on]
        return knn.search(self.records(filter), vector, k, self.spec.metric, keep=keep)

    def search_ids(self, vector: list[float], k: int = 10, **how: object) -> list[str]:
        return [r["id"] for r in self.search(vector, k, **how).select("id").collect()]  # k rows

    def search_vectors(self, vector: list[float], k: int = 10, **how: object) -> list[list[float]]:
        return [list(r["vector"]) for r in self.search(vector, k, include_vectors=True, **how).collect()]  # k rows

    def search_batch(self, queries: DataFrame, k: int = 10, *, filter: dict | str | None = None, mode: str = "exact", candidates: int = 200) -> DataFrame:
        """query_id, rank, id, distance of queries (query_id, vector). mode is exact, or a leaf mode
        that shortlists `candidates` rows by codes first. Exact without a filter reads only the cells
        that a kept index of this version can't rule out."""
        if mode == "exact" and filter is None and metrics.supports_centroid_bound(self.spec.metric):
            kept = self.collection.cells()
            if kept is not None:
                return ivf.search_pruned(kept, queries, k)
        rows = self.records(filter)
        if mode == "exact":
            return knn.search_batch(rows, queries, k, self.spec.metric)
        return quantize.search_codes(rows, queries, k, mode=mode, metric=self.spec.metric, candidates=candidates)

    def search_text(self, queries: DataFrame, k: int = 10, *, filter: dict | str | None = None) -> DataFrame:
        if not self.spec.text:
            raise ValueError("the index has no text")
        return lexical.search_text(self.records(filter), queries, k, tokenizer=self.spec.tokenizer)

    def search_named(self, name: str, queries: DataFrame, k: int = 10, *, filter: dict | str | None = None) -> DataFrame:
        """query_id, rank, id, distance by a named vector: queries (query_id, vector) of its kind; dense
        by its metric, sparse by inner product, late by MaxSim. Records without it don't take part."""
        of = self.spec.named.get(name)
        rows = self.collection.vectors_of(name, self.records(filter))
        if of["kind"] == "sparse":
            return lexical.search_sparse(rows, queries, k, sparse="vector", query_sparse="vector")
        if of["kind"] == "late":
            return late.search_late(rows, queries, k, tokens="vector", query_tokens="vector")
        return knn.search_batch(rows, queries, k, of.get("metric", self.spec.metric))

    def search_hybrid(self, queries: DataFrame, k: int = 10, *, rrf_k: float = 60, weights: dict[str, float] | None = None, depth: int | None = None, filter: dict | str | None = None) -> DataFrame:
        """queries: query_id and any of vector, text, named, sparse and multi (maps from names to vectors,
        as records have them); each vector and the text is a leg of its own, named vectors by their names."""
        depth = max(knn.check_k(k), depth or hybrid.default_depth(k))
        legs, kinds = {}, {hybrid.PRIMARY: self.spec.metric}
        if "vector" in queries.columns:
            legs[hybrid.PRIMARY] = self.search_batch(queries.where("vector IS NOT NULL").select("query_id", "vector"), depth, filter=filter)
        if "text" in queries.columns:
            legs[hybrid.TEXT] = self.search_text(queries.where("text IS NOT NULL").select("query_id", "text"), depth, filter=filter)
        for name, of in self.spec.named.items():
            column = KINDS[of["kind"]]
            if column in queries.columns:
                asked = queries.select("query_id", F.try_element_at(column, F.lit(name)).alias("vector")).where("vector IS NOT NULL")
                legs[name] = self.search_named(name, asked, depth, filter=filter)
                kinds[name] = of.get("metric", self.spec.metric) if of["kind"] == "dense" else None
        if weights is not None:
            return hybrid.fuse_weighted(legs, k, weights, kinds)
        return hybrid.fuse_rrf(legs, k, rrf_k)

    def search_with_report(self, vector: list[float], k: int = 10, *, filter: dict | str | None = None) -> tuple[list, dict]:
        """The hits, and what was considered."""
        live = self.collection.live()
        seen = live.select(F.count("*").alias("n")).first()["n"]
        passed = self.records(filter).count() if filter is not None else seen
        hits = self.search(vector, k, filter=filter).collect()  # k rows
        return hits, {"records_considered": seen, "rows_passed_filter": passed, "records_scored": passed, "recall_guarantee": explain.guarantee(exact=True), "termination": "complete"}

    def explain(self, vector: list[float], k: int = 10, **how: object) -> str:
        return explain.physical_plan(self.search(vector, k, **how))

    def cells(self, **how: object) -> ivf.Cells:
        """A coarse index over the live records, for ivf.search and ivf.search_pruned: the kept one of
        this version, else a fresh one."""
        kept = None if how else self.collection.cells()
        return kept or ivf.build(self.records().select("id", "vector", "metadata"), self.spec.metric, **how)

    def get_record(self, id: str) -> dict | None:
        r = self.records().where(F.col("id") == id).first()
        return r.asDict() if r else None

    def get_vector(self, id: str) -> list[float] | None:
        r = self.get_record(id)
        return list(r["vector"]) if r and r["vector"] is not None else None

    def get_records(self, ids: list[str]) -> list[dict | None]:
        """In the wanted order; repeated ids repeat, unknown ones are None."""
        wanted = self.spark.createDataFrame([(n, i) for n, i in enumerate(ids)], "position int, id string")
        known = self.records().withColumn("__there", F.lit(True))
        rows = knn.get_records(known, wanted).collect()  # one row per wanted id
        return [{k: v for k, v in r.asDict().items() if k not in ("position", "__there")} if r["__there"] else None for r in rows]

    def list_records(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        return knn.list_records(self.records(), offset, limit)

    def __getattr__(self, name: str):  # noqa: ANN204
        if name in ("add", "add_vectors", "upsert", "delete", "purge", "compact", "rebuild", "finish_bulk_load", "gc", "flush", "stats"):
            return getattr(self.collection, name)
        raise AttributeError(name)
