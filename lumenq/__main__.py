"""python -m lumenq COMMAND: create, add, upsert, delete, search, search-text, search-sparse-named,
search-late-interaction, search-hybrid, explain, stats, list, flush, compact, rebuild, gc, purge, and maintain (compact, then gc)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from lumenq.index import Index
from lumenq.operators.lexical import densify
from lumenq.sources import files


def _records(spark, path: str, named: dict, dims: int):  # noqa: ANN001, ANN202
    if path.endswith((".parquet", ".parq")):
        return files.read_parquet(spark, path)
    rows = files.read_json(spark, path, {n: of["kind"] for n, of in named.items()})
    return rows.withColumn("vector", F.coalesce("vector", densify(F.col("sparse_vector"), dims).cast("array<float>")))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenq")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("create", "add", "upsert", "delete", "search", "search-text", "search-sparse-named", "search-late-interaction", "search-hybrid", "explain", "stats", "list", "flush", "compact", "rebuild", "gc", "purge", "maintain"):
        c = sub.add_parser(name)
        c.add_argument("uri")
        if name == "create":
            c.add_argument("--metric", default="euclidean")
            c.add_argument("--dimensions", type=int, required=True)
            c.add_argument("--text", action="store_true")
            c.add_argument("--element-type", default="float32")
            c.add_argument("--named", default="{}", help='a JSON object, e.g. {"title": {"kind": "dense", "dimensions": 8}}')
        if name in ("search-sparse-named", "search-late-interaction"):
            c.add_argument("--name", required=True)
            c.add_argument("--query", required=True, help='JSON: {"indices": [...], "values": [...]}, or an array of token vectors')
        if name in ("add", "upsert"):
            c.add_argument("input")
        if name == "delete":
            c.add_argument("ids", nargs="+")
        if name in ("search", "search-hybrid", "explain"):
            c.add_argument("--vector", required=name != "search-hybrid", help="a JSON array")
        if name in ("search-text", "search-hybrid"):
            c.add_argument("--text", required=name == "search-text")
        if name in ("search", "search-text", "search-sparse-named", "search-late-interaction", "search-hybrid", "explain"):
            c.add_argument("-k", type=int, default=10)
            c.add_argument("--filter", help="a JSON object")
        if name == "search-hybrid":
            c.add_argument("--rrf-k", type=float, default=60)
        if name == "list":
            c.add_argument("--offset", type=int, default=0)
            c.add_argument("--limit", type=int, default=100)
        if name in ("gc", "maintain"):
            c.add_argument("--delete", action="store_true")
            c.add_argument("--min-age-seconds", type=float, default=86_400)
    return p


def run(spark, argv: list[str]) -> list:  # noqa: ANN001
    """The result rows of a command, as plain objects."""
    a = parser().parse_args(argv)
    if a.command == "create":
        Index.create(spark, a.uri, metric=a.metric, dimensions=a.dimensions, text=a.text, element_type=a.element_type, named=json.loads(a.named))
        return []
    index = Index.open(spark, a.uri)
    where = json.loads(a.filter) if getattr(a, "filter", None) else None
    rows = lambda df: [r.asDict() for r in df.collect()]
    if a.command in ("add", "upsert"):
        getattr(index, a.command)(_records(spark, a.input, index.spec.named, index.spec.dimensions))
    elif a.command == "delete":
        return [{"deleted": index.delete(spark.createDataFrame([(i,) for i in a.ids], "id string"))}]
    elif a.command == "search":
        return rows(index.search(json.loads(a.vector), a.k, filter=where, include_metadata=True))
    elif a.command == "explain":
        return [{"plan": index.explain(json.loads(a.vector), a.k, filter=where)}]
    elif a.command == "search-text":
        return rows(index.search_text(spark.createDataFrame([(0, a.text)], "query_id int, text string"), a.k, filter=where))
    elif a.command in ("search-sparse-named", "search-late-interaction"):
        q = json.loads(a.query)
        if a.command == "search-sparse-named":
            kind, data = "struct<indices: array<bigint>, values: array<float>>", (q["indices"], [float(x) for x in q["values"]])
        else:
            kind, data = "array<array<float>>", [[float(x) for x in t] for t in q]
        return rows(index.search_named(a.name, spark.createDataFrame([(0, data)], f"query_id int, vector {kind}"), a.k, filter=where))
    elif a.command == "search-hybrid":
        given = {"vector": json.loads(a.vector) if a.vector else None, "text": a.text}
        kinds = {"vector": "array<float>", "text": "string"}
        used = {n: v for n, v in given.items() if v is not None}
        data = [(0, *[[float(x) for x in v] if n == "vector" else v for n, v in used.items()])]
        q = spark.createDataFrame(data, ", ".join(["query_id int", *[f"{n} {kinds[n]}" for n in used]]))
        return rows(index.search_hybrid(q, a.k, rrf_k=a.rrf_k, filter=where))
    elif a.command == "stats":
        return rows(index.stats())
    elif a.command == "list":
        return rows(index.list_records(a.offset, a.limit).select("id", "metadata"))
    elif a.command == "gc":
        return [{"folders": index.gc(dry_run=not a.delete, min_age_seconds=a.min_age_seconds)}]
    elif a.command == "maintain":
        index.compact()
        return [{"folders": index.gc(dry_run=not a.delete, min_age_seconds=a.min_age_seconds)}]
    else:
        getattr(index, a.command)()
    return []


def main() -> None:
    import sys

    from pyspark.sql import SparkSession

    for row in run(SparkSession.builder.getOrCreate(), sys.argv[1:]):
        print(json.dumps(row, default=str))


if __name__ == "__main__":
    main()
