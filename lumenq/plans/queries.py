"""The queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq import index
from lumenq.functions import codecs, metrics, text
from lumenq.operators import evaluation, filters, graph, hybrid, ivf, knn, late, lexical, quantize, versions
from lumenq.sources import collection, files
from lumenq.streaming import feed, ingest
from lumenq.util import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# 2. Applying a change feed

FEED_SQL = """w AS (SELECT ns, hlc, unhex(writer) AS writer, upsert_rows, deletes FROM write_batches),
c AS (
  SELECT ns, hlc, writer, 1 AS kind, i AS pos, upsert_rows[i].id AS id, upsert_rows[i].payload_key AS payload_key, upsert_rows[i].attributes AS attributes
  FROM (SELECT *, unnest(range(1, len(upsert_rows) + 1)) AS i FROM w WHERE upsert_rows IS NOT NULL)
  UNION ALL
  SELECT ns, hlc, writer, 0, i, deletes[i], NULL, NULL
  FROM (SELECT *, unnest(range(1, len(deletes) + 1)) AS i FROM w WHERE deletes IS NOT NULL)),
r AS (SELECT *, row_number() OVER (PARTITION BY ns, id ORDER BY hlc DESC NULLS LAST, writer DESC NULLS LAST, kind DESC, pos DESC) AS rn
  FROM c WHERE id IS NOT NULL AND id <> '')"""


@query(f"WITH {FEED_SQL} SELECT ns, id AS record_id, payload_key FROM r WHERE rn = 1 AND kind = 1")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    done = feed.apply_feed(spark, f"{sf}/write_batches.parquet", ["payload_key"])
    return done.live().select("ns", F.col("id").alias("record_id"), "payload_key")


@query(
    f"""WITH {FEED_SQL} SELECT ns, count(*) FILTER (kind = 1) AS live, count(*) FILTER (kind = 0) AS deleted,
max(hlc) AS newest_hlc FROM r WHERE rn = 1 GROUP BY ns"""
)
def p2_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    """Per namespace: live and deleted keys, newest change."""
    done = feed.apply_feed(spark, f"{sf}/write_batches.parquet", ["payload_key"])
    return done.newest().groupBy("ns").agg(
        F.count_if(~F.col("tombstone")).alias("live"), F.count_if("tombstone").alias("deleted"), F.max("sequence.hlc").alias("newest_hlc")
    )


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# Distances: every vector of embeddings against the first one

BASE = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT v AS q FROM e WHERE vec_id = 0),
p AS (SELECT vec_id, unnest(q) AS a, unnest(v) AS b, unnest(range(64)) AS i FROM e, q)"""
PLAIN = f"WITH {BASE}, p1 AS (SELECT vec_id, i, a AS x, b AS y FROM p)"
POSITIVE = f"WITH {BASE}, p1 AS (SELECT vec_id, i, abs(a) AS x, abs(b) AS y FROM p)"
BINARY = f"""WITH {BASE}, p0 AS (SELECT vec_id, CASE WHEN a > 0 THEN 1 ELSE 0 END AS x, CASE WHEN b > 0 THEN 1 ELSE 0 END AS y FROM p),
p1 AS (SELECT vec_id, CAST(sum(x * y) AS DOUBLE) AS n11, CAST(sum((1 - x) * (1 - y)) AS DOUBLE) AS n00, CAST(sum(x * (1 - y)) AS DOUBLE) AS n10,
CAST(sum((1 - x) * y) AS DOUBLE) AS n01, CAST(64 AS DOUBLE) AS n FROM p0 GROUP BY vec_id)"""
SHARES = f"""WITH {BASE}, p1 AS (SELECT vec_id, i, abs(a) / sum(abs(a)) OVER (PARTITION BY vec_id) AS x, abs(b) / sum(abs(b)) OVER (PARTITION BY vec_id) AS y FROM p)"""
KL = "sum(CASE WHEN {0} > 1.1920929e-7 THEN {0} * ln({0} / {1}) ELSE 0 END)"
COS = "greatest(-1, least(1, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))))"


def _plain(v):  # noqa: ANN001, ANN202
    return v.cast("array<double>")


def _positive(v):  # noqa: ANN001, ANN202
    return F.transform(_plain(v), lambda x: F.abs(x))


def _binary(v):  # noqa: ANN001, ANN202
    return F.transform(_plain(v), lambda x: F.when(x > 0, 1.0).otherwise(0.0))


# metric: (preparation, SQL prelude, SQL aggregate over pairs x, y of a vector or SQL expression)
METRIC_SQL = {
    "euclidean": (_plain, PLAIN, "sqrt(sum((x - y) * (x - y)))"),
    "squared-euclidean": (_plain, PLAIN, "sum((x - y) * (x - y))"),
    "cosine": (_plain, PLAIN, f"1 - {COS}"),
    "inner-product": (_plain, PLAIN, "-sum(x * y)"),
    "angular": (_plain, PLAIN, f"acos({COS}) / pi()"),
    "manhattan": (_plain, PLAIN, "sum(abs(x - y))"),
    "gower": (_plain, PLAIN, "sum(abs(x - y)) / 64"),
    "chebyshev": (_plain, PLAIN, "max(abs(x - y))"),
    "minkowski:3": (_plain, PLAIN, "pow(sum(pow(abs(x - y), 3)), 1 / CAST(3 AS DOUBLE))"),
    "canberra": (_plain, PLAIN, "sum(CASE WHEN abs(x) + abs(y) <= 1.1920929e-7 THEN 0 ELSE abs(x - y) / (abs(x) + abs(y)) END)"),
    "bray-curtis": (_plain, PLAIN, "sum(abs(x - y)) / sum(abs(x + y))"),
    "correlation": (_plain, PLAIN, "1 - corr(x, y)"),
    "hamming": (_plain, PLAIN, "CAST(sum(CASE WHEN abs(x - y) > 1.1920929e-7 THEN 1 ELSE 0 END) AS DOUBLE)"),
    "jaccard": (_binary, BINARY, "CASE WHEN n - n00 = 0 THEN 0 ELSE 1 - n11 / (n - n00) END"),
    "dice": (_binary, BINARY, "1 - 2 * n11 / (2 * n11 + n10 + n01)"),
    "simple-matching": (_binary, BINARY, "(n10 + n01) / n"),
    "russell-rao": (_binary, BINARY, "1 - n11 / n"),
    "rogers-tanimoto": (_binary, BINARY, "2 * (n10 + n01) / (n11 + n00 + 2 * (n10 + n01))"),
    "sokal-sneath": (_binary, BINARY, "2 * (n10 + n01) / (n11 + 2 * (n10 + n01))"),
    "yule": (_binary, BINARY, "CASE WHEN n11 * n00 + n10 * n01 = 0 THEN 0 ELSE 2 * n10 * n01 / (n11 * n00 + n10 * n01) END"),
    "hellinger": (_positive, SHARES, "sqrt(1 - greatest(0, least(1, sum(sqrt(x * y)))))"),
    "chi-square": (_positive, POSITIVE, "sum(CASE WHEN x + y <= 1.1920929e-7 THEN 0 ELSE (x - y) * (x - y) / (x + y) END)"),
    "kullback-leibler": (_positive, SHARES, KL.format("x", "y")),
    "jeffreys": (_positive, SHARES, KL.format("x", "y") + " + " + KL.format("y", "x")),
    "jensen-shannon": (_positive, SHARES, f"sqrt(greatest(0, ({KL.format('x', '((x + y) / 2)')} + {KL.format('y', '((x + y) / 2)')}) / 2))"),
    "bhattacharyya": (_positive, SHARES, "-ln(least(1, sum(sqrt(x * y))))"),
    "wasserstein": (
        _positive,
        SHARES.replace("p1 AS", "p2 AS") + ", p1 AS (SELECT vec_id, abs(sum(x - y) OVER (PARTITION BY vec_id ORDER BY i)) AS w FROM p2)",
        "sum(w)",
    ),
    "dynamic-time-warping": (_plain, None, None),
    "ruzicka": (_positive, POSITIVE, "1 - sum(least(x, y)) / sum(greatest(x, y))"),
    "squared-chord": (_positive, POSITIVE, "sum((sqrt(x) - sqrt(y)) * (sqrt(x) - sqrt(y)))"),
    "wave-hedges": (_positive, POSITIVE, "sum(CASE WHEN greatest(x, y) <= 1.1920929e-7 THEN 0 ELSE abs(x - y) / greatest(x, y) END)"),
    "lorentzian": (_plain, PLAIN, "sum(ln(1 + abs(x - y)))"),
    "clark": (_plain, PLAIN, "sqrt(sum(CASE WHEN abs(x) + abs(y) <= 1.1920929e-7 THEN 0 ELSE pow(abs(x - y) / (abs(x) + abs(y)), 2) END))"),
}


def _metric(name: str, prepare: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = table(spark, sf, "embeddings")
        first = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
        both = e.select("vec_id", "embedding").crossJoin(F.broadcast(first))  # one row
        d = metrics.distance(name, prepare(F.col("q")), prepare(F.col("embedding")))
        return both.select("vec_id", (F.round(d, 6) + 0.0).alias("distance"))

    return run


for _name, (_prepare, _with, _expr) in METRIC_SQL.items():
    _group = "" if _with is BINARY else " GROUP BY vec_id"
    add(
        "metric_" + _name.replace("-", "_").replace(":", "_"),
        _metric(_name, _prepare),
        _with and f"{_with} SELECT vec_id, round(CAST({_expr} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS distance FROM p1{_group}",
    )


# Dynamic time warping by anti-diagonals: d1 and d2 are the last two, by the place in the first vector.
SQL["metric_dynamic_time_warping"] = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0),
d(vec_id, s, q, v, d1, d2) AS (
  SELECT vec_id, 0, q, v, [CASE WHEN i = 1 THEN abs(q[1] - v[1]) ELSE CAST(1e300 AS DOUBLE) END for i in range(1, 65)], [CAST(1e300 AS DOUBLE) for i in range(1, 65)] FROM e, q
  UNION ALL
  SELECT vec_id, s + 1, q, v, [CASE WHEN s + 3 - i BETWEEN 1 AND 64 THEN abs(q[i] - v[s + 3 - i]) + least(coalesce(d1[i - 1], 1e300), coalesce(d1[i], 1e300), coalesce(d2[i - 1], 1e300))
    ELSE 1e300 END for i in range(1, 65)], d1 FROM d WHERE s < 126)
SELECT vec_id, round(d1[64], 6) + CAST(0 AS DOUBLE) AS distance FROM d WHERE s = 126"""


# Exact k-NN


@query(
    f"""{PLAIN}, d AS (SELECT vec_id, 1 - {COS} AS d FROM p1 GROUP BY vec_id)
SELECT vec_id, round(d, 6) + CAST(0 AS DOUBLE) AS distance FROM d ORDER BY d, vec_id LIMIT 10"""
)
def knn_exact_cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    hits = knn.search(e, q, 10, "cosine", id="vec_id", vector="embedding")
    return hits.select(F.col("id").alias("vec_id"), (F.round("distance", 6) + 0.0).alias("distance"))


BATCH_D = {
    "euclidean": "list_distance(a.v, b.v)",
    "cosine": "list_cosine_distance(a.v, b.v)",
    "inner-product": "-list_inner_product(a.v, b.v)",
    "manhattan": "list_sum([abs(a.v[i] - b.v[i]) for i in range(1, 65)])",
}


def batch_sql(metric: str, where: str = "", k: int = 10, name: str = "h") -> str:
    """CTEs e and name(query_id, rank, id, distance): every 20th vector against all."""
    return f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{name} AS (SELECT query_id, rank, id, distance FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, d AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS rank
  FROM (SELECT a, b, {BATCH_D[metric]} AS d FROM e a, e b WHERE a.vec_id % 20 = 0 {where}) AS z) WHERE rank <= {k})"""


def _batch(spark: SparkSession, sf: str, metric: str, k: int = 10, where: Column | None = None) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return knn.search_batch(e, e.where("vec_id % 20 = 0"), k, metric, id="vec_id", vector="embedding", query_id="vec_id", query_vector="embedding", where=where)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6) + 0.0)


HITS = "SELECT query_id, CAST(rank AS INT) AS rank, id, round(distance, 6) + CAST(0 AS DOUBLE) AS distance FROM h"
for _m in BATCH_D:
    add("knn_batch_" + _m.replace("-", "_"), lambda spark, sf, m=_m: _rounded(_batch(spark, sf, m)), f"WITH {batch_sql(_m)} {HITS}")


@query(f"WITH {batch_sql('cosine', 'AND b.label IN (1, 3)')} {HITS}")
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_batch(spark, sf, "cosine", where=F.col("label").isin(1, 3)))


def _cells(spark: SparkSession, sf: str, metric: str = "euclidean") -> ivf.Cells:
    return ivf.build(table(spark, sf, "embeddings"), metric, id="vec_id", vector="embedding")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0")


NAMES = {"query_id": "vec_id", "query_vector": "embedding"}


@query(f"WITH {batch_sql('euclidean')} {HITS}")
def knn_cells_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Exact, reading only cells that the triangle inequality can't rule out."""
    return _rounded(ivf.search_pruned(_cells(spark, sf), _asked(spark, sf), 10, **NAMES))


@query(f"WITH {batch_sql('cosine')} {HITS}")
def knn_cells_pruned_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ivf.search_pruned(_cells(spark, sf, "cosine"), _asked(spark, sf), 10, **NAMES))


def _recall(hits: DataFrame, exact: DataFrame) -> DataFrame:
    a = evaluation.collect_ids(exact).select("query_id", F.col("ids").alias("x"), F.col("distances").alias("dx"))
    b = evaluation.collect_ids(hits).select("query_id", F.col("ids").alias("y"), F.col("distances").alias("dy"))
    both = a.join(b, "query_id")
    return both.select("query_id", evaluation.recall_at_k(F.col("x"), F.col("y"), 10).alias("recall"), evaluation.tie_aware_recall_at_k(F.col("dx"), F.col("dy"), 10).alias("tie_aware_recall"))


@query(
    f"""WITH {batch_sql('cosine')} SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(rank AS INT) AS rank, CAST(id AS VARCHAR) AS id, round(distance, 6) + CAST(0 AS DOUBLE) AS distance FROM h"""
)
def knn_kept_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Exact, from the coarse index that finish_bulk_load keeps with a collection."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    made = index.Index.create(spark, scratch_path(spark, "kept"), metric="cosine", dimensions=64)
    made.add(rows)
    made.finish_bulk_load()
    return _rounded(made.search_batch(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10))


@query()
def knn_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate: the nearest three quarters of the cells (the vectors are hardly clustered), with
    recall per query."""
    index = _cells(spark, sf)
    hits = ivf.search(index, _asked(spark, sf), 10, nprobe=max(1, 3 * len(index.centroids) // 4), **NAMES)
    return _recall(hits, _batch(spark, sf, "euclidean"))


for _mode in quantize.LEAF_MODES:
    add(
        "leaf_" + _mode.replace("-", "_"),
        lambda spark, sf, m=_mode: _recall(
            quantize.search_codes(table(spark, sf, "embeddings"), _asked(spark, sf), 10, mode=m, candidates=200, id="vec_id", vector="embedding", **NAMES), _batch(spark, sf, "euclidean")
        ),
    )
for _mode in ("graph", "vamana-pq"):
    add(
        "leaf_" + _mode.replace("-", "_"),
        lambda spark, sf, m=_mode: _recall(graph.search_graph(_cells(spark, sf), _asked(spark, sf), 10, nprobe=16, mode=m, **NAMES), _batch(spark, sf, "euclidean")),
    )


@query(
    f"""WITH {batch_sql('cosine', k=20)}, r AS (SELECT query_id, id, 1 / (1 + abs(query_id - id)) AS s FROM h)
SELECT query_id, CAST(rank AS INT) AS rank, id, round(-s, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -s, id) AS rank FROM r) WHERE rank <= 5"""
)
def knn_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(knn.rerank(_batch(spark, sf, "cosine", 20), 1 / (1 + F.abs(F.col("query_id") - F.col("id"))), 5))


@query(
    "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100"
)
def list_records(spark: SparkSession, sf: str) -> DataFrame:
    return knn.list_records(table(spark, sf, "documents").select("doc_id", "lang", "source"), 100, 50, id="doc_id")


# Metadata filters over records.metadata

FILTERS = {
    "eq": ({"genre": "guide"}, "genre = 'guide'"),
    "ne": ({"genre": {"$ne": "guide"}}, "genre IS NULL OR genre <> 'guide'"),
    "range": ({"year": {"$gte": 2012, "$lt": 2019}}, "coalesce(year >= 2012 AND year < 2019, false)"),
    "in": ({"genre": {"$in": ["note", "paper"]}}, "coalesce(genre IN ('note', 'paper'), false)"),
    "nin": ({"genre": {"$nin": ["note", "paper"]}}, "NOT coalesce(genre IN ('note', 'paper'), false)"),
    "exists": ({"live": {"$exists": True}}, "json_exists(m, '$.live')"),
    "regex": ({"genre": {"$regex": "^(gu|sn)i"}}, "coalesce(regexp_matches(genre, '^(gu|sn)i'), false)"),
    "cross_type": ({"$or": [{"year": {"$gt": "2000"}}, {"genre": {"$gt": "note"}}, {"genre": {"$lt": 5}}]}, "coalesce(genre > 'note', false)"),
    "bool_and": ({"$and": [{"live": True}, {"$or": [{"year": {"$lt": 2012}}, {"genre": "ticket"}]}]}, "coalesce(live AND (year < 2012 OR genre = 'ticket'), false)"),
    "not": ({"$not": {"live": True}}, "NOT coalesce(live, false)"),
    "geo": (
        {"loc": {"$geoRadius": {"lat": 48.0, "lon": 10.0, "radius": 8_000_000}}},
        """coalesce(2 * 6371008.8 * asin(sqrt(least(1, pow(sin((radians(loc[1]) - radians(48)) / 2), 2)
+ cos(radians(48)) * cos(radians(loc[1])) * pow(sin((radians(loc[2]) - radians(10)) / 2), 2)))) <= 8000000, false)""",
    ),
}


def _filter(spec: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, "records").select("id", filters.parse_metadata(F.col("metadata")).alias("m"))
        return rows.where(filters.compile_filter(spec, F.col("m"))).select("id").distinct()

    return run


for _n, (_spec, _sql) in FILTERS.items():
    add(
        "filter_" + _n,
        _filter(_spec),
        f"""WITH r AS (SELECT id, CAST(metadata AS JSON) AS m FROM records),
r1 AS (SELECT *, m ->> '$.genre' AS genre, CAST(m -> '$.year' AS BIGINT) AS year, CAST(m -> '$.live' AS BOOLEAN) AS live, CAST(m -> '$.loc' AS DOUBLE[]) AS loc FROM r)
SELECT DISTINCT id FROM r1 WHERE {_sql}""",
    )


@query("SELECT doc_id FROM documents WHERE lang = 'en' OR source = 'forum-archive'")
def filter_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Over metadata made of the documents' language and source: arrays that hold either of two values."""
    tags = F.to_json(F.struct(F.array("lang", "source").alias("tags")))
    rows = table(spark, sf, "documents").select("doc_id", filters.parse_metadata(tags).alias("m"))
    return rows.where(filters.compile_filter({"$or": [{"tags": {"$contains": "en"}}, {"tags": {"$contains": "forum-archive"}}]}, F.col("m"))).select("doc_id")


# Text

TOKENS_SQL = "t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents WHERE text IS NOT NULL)"


@query(
    f"WITH {TOKENS_SQL}, w AS (SELECT doc_id, unnest(t) AS term FROM t) SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM w GROUP BY term"
)
def text_terms(spark: SparkSession, sf: str) -> DataFrame:
    posts = lexical.postings(table(spark, sf, "documents"), id="doc_id")
    return posts.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"))


@query(
    "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0b]+')) AS term FROM documents) SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM w GROUP BY doc_id"
)
def text_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", text.tokenize(F.col("text"), "whitespace").alias("t"))
    return t.where(F.size("t") > 0).select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("terms"))


@query(
    "SELECT doc_id, CAST(greatest(length(text) - 2, 0) AS BIGINT) AS ngrams FROM documents WHERE text IS NOT NULL"
)
def text_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.size(text.tokenize(F.col("text"), "ngram:3")).cast("bigint").alias("ngrams"))


@query(
    """WITH t AS (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT DISTINCT unnest(t) AS term FROM t), h AS (SELECT term, hex(encode(term)) AS h FROM w)
SELECT term, list_reduce([CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) for i in range(1, length(h) // 2 + 1)],
  lambda s, x: (xor(s, x) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS term_id FROM h"""
)
def text_term_ids(spark: SparkSession, sf: str) -> DataFrame:
    posts = lexical.postings(table(spark, sf, "documents"), id="doc_id").select("term").distinct()
    return posts.select("term", text.term_ids(F.array("term"))[0].alias("term_id"))


BM25_SQL = f"""{TOKENS_SQL},
w AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t WHERE len(t) > 0),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS avgdl FROM t WHERE len(t) > 0),
qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM eval_items),
sc AS (SELECT item_id AS query_id, doc_id AS id, sum(ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.2 AS DOUBLE)
  / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term), st GROUP BY ALL),
bm AS (SELECT query_id, id, -score AS distance, row_number() OVER (PARTITION BY query_id ORDER BY -round(score, 9), id) AS rank FROM sc WHERE score > 0)"""


def _bm25(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return lexical.search_text(table(spark, sf, "documents"), table(spark, sf, "eval_items"), k, id="doc_id", query_id="item_id")


@query(f"WITH {BM25_SQL} SELECT query_id, CAST(rank AS INT) AS rank, id, round(distance, 6) AS distance FROM bm WHERE rank <= 10")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_bm25(spark, sf, 10))


SPARSE_SQL = """d AS (SELECT DISTINCT id, sparse FROM records WHERE sparse IS NOT NULL),
x AS (SELECT id, unnest(sparse.indices) AS term, CAST(unnest(sparse.values) AS DOUBLE) AS w FROM d),
s AS (SELECT q.id AS query_id, r.id AS id, sum(q.w * r.w) AS dot FROM x q JOIN x r USING (term) GROUP BY ALL),
h AS (SELECT query_id, id, -dot AS distance, row_number() OVER (PARTITION BY query_id ORDER BY -round(dot, 9), id) AS rank FROM s WHERE dot > 0)"""


@query(f"WITH {SPARSE_SQL} SELECT query_id, CAST(rank AS INT) AS rank, id, round(distance, 6) AS distance FROM h WHERE rank <= 5")
def sparse_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "records").where("sparse IS NOT NULL").select("id", "sparse").distinct()
    return _rounded(lexical.search_sparse(rows, rows, 5, query_id="id", strict=False))


# Multi-vectors: runs of eight embeddings are one record

LATE_SQL = """e AS (SELECT vec_id // 8 AS doc, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
m AS (SELECT a.doc AS query_id, b.doc AS id, a.vec_id AS t, max(list_inner_product(a.v, b.v)) AS best FROM e a, e b WHERE a.doc % 20 = 0 GROUP BY ALL),
s AS (SELECT query_id, id, -sum(best) AS distance FROM m GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM s)"""


def _multi(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("id"), "vec_id", "embedding")
    rows = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))  # eight at most
    return e.groupBy("id").agg(F.transform(rows, lambda r: r["embedding"]).alias("tokens"))


@query(f"WITH {LATE_SQL} SELECT query_id, CAST(rank AS INT) AS rank, id, round(distance, 6) AS distance FROM h WHERE rank <= 5")
def late_maxsim(spark: SparkSession, sf: str) -> DataFrame:
    docs = _multi(spark, sf)
    return _rounded(late.search_late(docs, docs.where("id % 20 = 0"), 5, query_id="id"))


@query()
def late_bounded(spark: SparkSession, sf: str) -> DataFrame:
    docs = _multi(spark, sf)
    return _rounded(late.search_late_bounded(docs, docs.where("id % 20 = 0"), 5, 20, query_id="id"))


# Hybrid: the items' texts and the vectors numbered like them, over documents and embeddings

HYBRID_SQL = f"""{BM25_SQL},
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dn AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
  FROM (SELECT item_id AS query_id, b.vec_id AS id, list_cosine_distance(a.v, b.v) AS distance FROM eval_items, e a, e b WHERE a.vec_id = item_id - 1001)),
legs AS (SELECT 'dense' AS leg, query_id, id, rank, 1 / (1 + distance) AS score FROM dn WHERE rank <= 100
  UNION ALL SELECT 'text', query_id, id, rank, -distance FROM bm WHERE rank <= 100)"""


def _legs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    e = table(spark, sf, "embeddings")
    asked = table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), (F.col("item_id") - 1001).alias("vec_id")).join(e, "vec_id")
    dense = knn.search_batch(e, asked.select("query_id", "embedding"), hybrid.default_depth(10), "cosine", id="vec_id", vector="embedding", query_vector="embedding")
    return {hybrid.PRIMARY: dense, hybrid.TEXT: _bm25(spark, sf, hybrid.default_depth(10))}


@query(
    f"""WITH {HYBRID_SQL}, f AS (SELECT query_id, id, -sum(1 / (CAST(60 AS DOUBLE) + rank - 1)) AS distance FROM legs GROUP BY ALL)
SELECT query_id, CAST(rank AS INT) AS rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM f) WHERE rank <= 10"""
)
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(hybrid.fuse_rrf(_legs(spark, sf), 10, 60))


@query(
    f"""WITH {HYBRID_SQL}, m AS (SELECT *, score / max(score) OVER (PARTITION BY query_id, leg) AS part FROM legs),
f AS (SELECT query_id, id, -sum(CASE WHEN leg = 'dense' THEN part ELSE 2 * part END) AS distance FROM m GROUP BY ALL)
SELECT query_id, CAST(rank AS INT) AS rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM f) WHERE rank <= 10"""
)
def hybrid_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(hybrid.fuse_weighted(_legs(spark, sf), 10, {hybrid.TEXT: 2.0}, {hybrid.PRIMARY: "cosine"}))


# Named vectors of a collection: the first half of an embedding, its positive part, its halves as tokens

NAMED = {
    "half": {"kind": "dense", "metric": "euclidean", "dimensions": 32},
    "positive": {"kind": "sparse"},
    "halves": {"kind": "late", "dimensions": 32},
}
NAMED_SQL = """e AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id % 20 = 0 AS asked, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.id AS query_id, b.id AS id, list_cosine_distance(a.v, b.v) AS whole, list_distance(a.v[1:32], b.v[1:32]) AS half,
    -list_inner_product([greatest(x, 0) for x in a.v], [greatest(x, 0) for x in b.v]) AS positive,
    -greatest(list_inner_product(a.v[1:32], b.v[1:32]), list_inner_product(a.v[1:32], b.v[33:64])) - greatest(list_inner_product(a.v[33:64], b.v[1:32]), list_inner_product(a.v[33:64], b.v[33:64])) AS halves
  FROM e a, e b WHERE a.asked),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY whole, id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY half, id) AS r2,
    row_number() OVER (PARTITION BY query_id ORDER BY round(positive, 9), id) AS r3, row_number() OVER (PARTITION BY query_id ORDER BY round(halves, 9), id) AS r4 FROM p),
h AS (SELECT query_id, id, -(CASE WHEN r1 <= 100 THEN 1 / CAST(59 + r1 AS DOUBLE) ELSE 0 END + CASE WHEN r2 <= 100 THEN 1 / CAST(59 + r2 AS DOUBLE) ELSE 0 END
    + CASE WHEN r3 <= 100 AND positive < 0 THEN 1 / CAST(59 + r3 AS DOUBLE) ELSE 0 END + CASE WHEN r4 <= 100 THEN 1 / CAST(59 + r4 AS DOUBLE) ELSE 0 END) AS fused FROM r)"""


def _named(spark: SparkSession, sf: str) -> tuple[index.Index, DataFrame]:
    """An index of embeddings with named vectors, and every 20th record as a query."""
    v = F.col("embedding")
    at = F.filter(F.transform(v, lambda x, i: F.struct(i.cast("bigint").alias("i"), x.alias("x"))), lambda t: t["x"] > 0)
    part = F.struct(F.transform(at, lambda t: t["i"]).alias("indices"), F.transform(at, lambda t: t["x"]).alias("values"))
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        v.alias("vector"),
        F.create_map(F.lit("half"), F.slice(v, 1, 32)).alias("named"),
        F.create_map(F.lit("positive"), part).alias("sparse"),
        F.create_map(F.lit("halves"), F.array(F.slice(v, 1, 32), F.slice(v, 33, 32))).alias("multi"),
    )
    made = index.Index.create(spark, scratch_path(spark, "named"), metric="cosine", dimensions=64, named=NAMED)
    made.add(rows)
    return made, rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")


def _by_name(name: str, column: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        made, asked = _named(spark, sf)
        return _rounded(made.search_named(name, asked.select("query_id", F.col(column)[name].alias("vector")), 10))

    return run


for _name, _column, _field, _rank in (("dense_named", "named", "half", "r2"), ("sparse_named", "sparse", "positive", "r3"), ("late_named", "multi", "halves", "r4")):
    add(_name, _by_name(_field, _column), f"WITH {NAMED_SQL} SELECT query_id, CAST({_rank} AS INT) AS rank, id, round({_field}, 6) + CAST(0 AS DOUBLE) AS distance FROM r WHERE {_rank} <= 10 AND ({_rank} <> r3 OR positive < 0)")


@query(
    f"""WITH {NAMED_SQL} SELECT query_id, CAST(rank AS INT) AS rank, id, round(fused, 6) AS distance FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9), id) AS rank FROM h WHERE fused < 0) WHERE rank <= 10"""
)
def hybrid_named(spark: SparkSession, sf: str) -> DataFrame:
    """The primary, a named dense, a sparse and a token-level leg fused by ranks."""
    made, asked = _named(spark, sf)
    return _rounded(made.search_hybrid(asked, 10))


# Evaluation


def _second(metric: str, name: str) -> str:
    both = batch_sql(metric, name=name)
    return both[both.index(f"{name} AS (SELECT query_id") :]


@query(
    f"""WITH {batch_sql('euclidean')}, {_second('cosine', 'g')}
SELECT query_id, CAST(count(g.id) AS DOUBLE) / count(*) AS recall FROM h LEFT JOIN g USING (query_id, id) GROUP BY query_id"""
)
def eval_recall(spark: SparkSession, sf: str) -> DataFrame:
    a = evaluation.collect_ids(_batch(spark, sf, "euclidean")).select("query_id", F.col("ids").alias("x"))
    b = evaluation.collect_ids(_batch(spark, sf, "cosine")).select("query_id", F.col("ids").alias("y"))
    return a.join(b, "query_id").select("query_id", evaluation.recall_at_k(F.col("x"), F.col("y"), 10).alias("recall"))


@query(
    f"""WITH {batch_sql('cosine')}, j AS (SELECT a.vec_id AS query_id, b.vec_id AS id FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.label = b.label),
n AS (SELECT query_id, least(count(*), 10) AS n FROM j GROUP BY 1),
i AS (SELECT query_id, sum(1 / log2(r + CAST(1 AS DOUBLE))) AS ideal FROM (SELECT query_id, unnest(range(1, n + 1)) AS r FROM n) GROUP BY 1),
g AS (SELECT query_id, sum(1 / log2(rank + CAST(1 AS DOUBLE))) AS dcg, min(rank) AS first, count(*) AS c FROM h JOIN j USING (query_id, id) GROUP BY 1)
SELECT query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(1 / CAST(first AS DOUBLE), 0), 6) AS mrr, CAST(coalesce(c, 0) AS DOUBLE) / 10 AS precision FROM i LEFT JOIN g USING (query_id)"""
)
def eval_ranking(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    judged = e.select(F.col("vec_id").alias("id"), "label").join(asked, "label").select("query_id", "id", F.lit(1).alias("grade"))
    q = evaluation.ranking_quality(_batch(spark, sf, "cosine"), judged, 10)
    return q.select("query_id", F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"), "precision")


# Mutations


@query(
    """SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def lww_batch(spark: SparkSession, sf: str) -> DataFrame:
    now = versions.current_rows(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])
    return now.withColumn("value", F.round("value", 6))


@query(SQL["lww_batch"])
def lww_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stream, with keyed state and batch-versioned output."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    changes = feed.stream_of(spark, f"{sf}/events.parquet", schema).select(
        "user_id",
        F.struct(F.col("ts").alias("ts"), F.col("event_id").alias("event_id"), F.lit(1).alias("kind")).alias("sequence"),
        F.struct("event_id", "event_type", "value").alias("payload"),
    )
    done = feed.ChangeTable(spark, scratch_path(spark, "events"), ["user_id"])
    done.run(changes)
    return done.live().withColumn("value", F.round("value", 6))


@query(
    """WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, embedding[1] AS x FROM embeddings)
SELECT id, CAST(CASE WHEN label = 2 THEN -x ELSE x END AS DOUBLE) AS x FROM e WHERE label <> 3"""
)
def collection_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Add all, replace one label's vectors by their negatives, delete another label's, compact, purge."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label")
    c = collection.Collection.create(spark, scratch_path(spark, "collection"), collection.Spec("cosine", 64))
    c.add(rows.drop("label"))
    c.upsert(rows.where("label = 2").withColumn("vector", F.transform("vector", lambda x: -x)).drop("label"))
    c.delete(rows.where("label = 3").select("id"))
    c.compact()
    c.purge()
    return c.live().select("id", F.get("vector", F.lit(0)).cast("double").alias("x"))


@query("SELECT count(*) AS records, count(*) AS vectors, CAST(0 AS BIGINT) AS sparse_vectors, CAST(0 AS BIGINT) AS texts FROM embeddings")
def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    c = collection.Collection.create(spark, scratch_path(spark, "collection"), collection.Spec("cosine", 64))
    c.add(rows)
    return c.stats().select("records", "vectors", "sparse_vectors", "texts")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS dimensions FROM embeddings")
def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Written in the exchange layout and read back."""
    path = scratch_path(spark, "exchange")
    files.write_parquet(table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")), path)
    return files.read_parquet(spark, path).select("id", F.size("vector").cast("bigint").alias("dimensions"))


@query("SELECT vec_id, round(CAST(list_sum([round(x * 100) for x in CAST(embedding AS DOUBLE[])]) AS DOUBLE), 6) AS total FROM embeddings")
def codec_int8(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 100))
    e = table(spark, sf, "embeddings").select("vec_id", codecs.canonical(v, "int8").alias("v"))
    return e.select("vec_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"))


# Significant bits and smallest exponent of the small floats
SMALL_FLOATS = {"float16": (10, -14), "bfloat16": (7, -126), "float8-e4m3fn": (3, -6), "float8-e5m2": (2, -14), "binary": None}

for _kind, _form in SMALL_FLOATS.items():

    def _codec(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        e = table(spark, sf, "embeddings")
        v = _binary(F.col("embedding")) if kind == "binary" else F.col("embedding")
        s = e.select("vec_id", codecs.canonical(v, kind).alias("v"))
        again = F.aggregate(F.zip_with("v", codecs.canonical(F.col("v"), kind), lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda x, d: x + d)
        total = F.aggregate("v", F.lit(0.0), lambda x, d: x + d.cast("double"))
        return s.select("vec_id", F.round(total, 6).alias("total"), (again == 0).alias("stable"))

    if _form is None:
        _value = "CASE WHEN x > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END"
    else:
        _step = f"pow(CAST(2 AS DOUBLE), greatest(floor(log2(abs(x))), {_form[1]}) - {_form[0]})"
        _value = f"CASE WHEN x = 0 THEN 0 ELSE round_even(x / {_step}, 0) * {_step} END"
    add("codec_" + _kind.replace("-", "_"), _codec, f"SELECT vec_id, round(CAST(list_sum([{_value} for x in CAST(embedding AS DOUBLE[])]) AS DOUBLE), 6) AS total, true AS stable FROM embeddings")


@query()
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """documents as a stream of puts into a collection, and what is live afterwards."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    c = collection.Collection.create(spark, scratch_path(spark, "collection"), collection.Spec("cosine", 1, text=True))
    puts = feed.stream_of(spark, f"{sf}/documents.parquet", schema).select(
        F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("array<float>").alias("vector"), "text", F.to_json(F.struct("lang", "source")).alias("metadata"), F.lit("put").alias("op"), F.col("doc_id").alias("seq")
    )
    ingest.ingest(puts, c, scratch_path(spark, "ingest")).awaitTermination()
    return c.refresh().live().select(F.col("id").cast("bigint").alias("doc_id"), "text")


SQL["stream_ingest"] = "SELECT doc_id, text FROM documents"
