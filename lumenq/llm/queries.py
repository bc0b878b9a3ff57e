"""The queries of the problems tagged llm, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm import clusters, enrichment, leakage, mixing, neighbours, quantiles, rankfusion, stuffing, terms, vectors
from lumenq.operators import knn
from lumenq.operators.versions import current_rows
from lumenq.util import broadcast_if_small, distinct_projection, materialize

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


CURRENT_SQL = """cur AS (
  SELECT index_name, record_id, terms FROM (
    SELECT *, row_number() OVER (PARTITION BY index_name, record_id ORDER BY generation DESC NULLS LAST) AS rn
    FROM (SELECT DISTINCT * FROM text_rows)) WHERE rn = 1),
post AS (
  SELECT index_name, record_id, t.term_id AS term_id, CAST(sum(t.tf) AS BIGINT) AS tf
  FROM (SELECT index_name, record_id, unnest(terms) AS t FROM cur)
  WHERE t.tf > 0 AND t.term_id IS NOT NULL GROUP BY ALL)"""


def current_text_rows(spark: SparkSession, sf: str) -> DataFrame:
    return current_rows(table(spark, sf, "text_rows"), ["index_name", "record_id"], ["generation", "hlc"], ["terms"])


# 1. Frequency of every distinct term


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return terms.marked_terms(terms.term_counts(current_text_rows(spark, sf), "index_name", "terms", "term_id", "tf"))


@query(
    f"""WITH {CURRENT_SQL}, n AS (SELECT index_name, count(DISTINCT record_id) AS n FROM post GROUP BY 1),
d AS (SELECT index_name, term_id, count(*) AS d FROM post GROUP BY 1, 2)
SELECT index_name, term_id, CASE WHEN d * 4 > n THEN 'common' ELSE 'rare' END AS mark
FROM d JOIN n USING (index_name) WHERE d * 4 > n OR d <= 2"""
)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    m = _marked(spark, sf).where("mark IS NOT NULL")
    return m.select(F.col("grp").alias("index_name"), F.col("term").alias("term_id"), "mark")


@query(
    f"""WITH {CURRENT_SQL}, n AS (SELECT index_name, count(DISTINCT record_id) AS n FROM post GROUP BY 1),
d AS (SELECT index_name, term_id, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records FROM post GROUP BY 1, 2)
SELECT index_name, term_id, occurrences, records, n AS index_records,
CASE WHEN records * 4 > n THEN 'common' WHEN records <= 2 THEN 'rare' END AS mark FROM d JOIN n USING (index_name)"""
)
def p1_term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select(
        F.col("grp").alias("index_name"), F.col("term").alias("term_id"), "occurrences", "records", F.col("group_records").alias("index_records"), "mark"
    )


@query(
    """SELECT index_name, term_id, CAST(sum(document_frequency) AS BIGINT) AS flushed_records, count(*) AS segments
FROM (SELECT DISTINCT * FROM lexical_term_blocks) WHERE document_frequency > 0 AND term_id IS NOT NULL GROUP BY 1, 2"""
)
def p1_block_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts over the blocks' document_frequency, as of flush time."""
    blocks = table(spark, sf, "lexical_term_blocks").dropDuplicates()
    rows = blocks.select("index_name", F.array(F.struct("term_id", "document_frequency")).alias("items"))
    counts = terms.term_counts(rows, "index_name", "items", "term_id", "document_frequency").where("term IS NOT NULL")
    return counts.select(
        F.col("grp").alias("index_name"), F.col("term").alias("term_id"), F.col("occurrences").alias("flushed_records"), F.col("records").alias("segments")
    )


# 3. Percentiles


def _measurements(spark: SparkSession, sf: str) -> DataFrame:
    """source_table, run_id, conf (the run's configuration), field, value, of all measurements."""
    native = distinct_projection(table(spark, sf, "native_queries"), ["run_id", "cell_no", "latency_ms", "recall"], ["run_id"])
    load = distinct_projection(table(spark, sf, "load_samples"), ["run_id", "endpoint", "engine", "recall_at_10"], ["run_id"])
    pair = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    a = native.select(
        F.lit("native_queries").alias("source_table"),
        "run_id",
        F.col("cell_no").cast("string").alias("conf"),
        F.inline(F.array(pair("latency_ms", F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))), pair("recall", F.col("recall")))),
    )
    b = load.select(
        F.lit("load_samples").alias("source_table"),
        "run_id",
        F.to_json(F.struct("endpoint", "engine")).alias("conf"),
        F.lit("recall_at_10").alias("field"),
        F.col("recall_at_10").alias("value"),
    )
    return a.unionByName(b)


RUN = ["source_table", "run_id", "conf", "field"]
CONF = ["source_table", "conf", "field"]
PCTS = [10, 50, 90]


def _run_and_conf(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    runs = materialize(quantiles.digests(_measurements(spark, sf), RUN, "value"), "run-digests")
    confs = quantiles.merge(runs, CONF)
    at = quantiles.percentile_columns(PCTS)
    return runs.select(*RUN, at.alias("p")), confs.select(*CONF, at.alias("p"))


P3_SQL = """m AS (
  SELECT 'native_queries' AS source_table, run_id, CAST(cell_no AS VARCHAR) AS conf, unnest(['latency_ms', 'recall']) AS field,
    unnest([CASE WHEN latency_ms >= 0 THEN latency_ms END, recall]) AS v FROM (SELECT DISTINCT * FROM native_queries)
  UNION ALL SELECT 'load_samples', run_id, endpoint || ' ' || engine, 'recall_at_10', recall_at_10 FROM (SELECT DISTINCT * FROM load_samples)),
u AS (SELECT * FROM m WHERE v IS NOT NULL AND NOT isnan(v)),
r AS (SELECT source_table, run_id, conf, field, quantile_disc(v, [0.1, 0.5, 0.9]) AS p FROM u GROUP BY ALL),
k AS (SELECT source_table, conf, field, quantile_disc(v, [0.1, 0.5, 0.9]) AS q FROM u GROUP BY ALL)"""


@query(
    f"""WITH {P3_SQL}, c AS (SELECT source_table, run_id, field, unnest([10, 50, 90]) AS pct,
  unnest([field <> 'latency_ms' AND p[1] <= q[1] - 0.25, field = 'latency_ms' AND p[2] >= 1.5 * q[2], field = 'latency_ms' AND p[3] >= 1.5 * q[3]]) AS f
  FROM r JOIN k USING (source_table, conf, field))
SELECT source_table, run_id, field, CAST(pct AS INT) AS pct FROM c WHERE f"""
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    runs, confs = _run_and_conf(spark, sf)
    both = runs.join(broadcast_if_small(materialize(confs.withColumnRenamed("p", "q"), "conf-percentiles"), 100_000), CONF)
    case = lambda i, test: F.when(test(F.col("p")[i], F.col("q")[i]), F.lit(PCTS[i]))
    high = lambda p, q: (F.col("field") == "latency_ms") & (p >= 1.5 * q)
    low = lambda p, q: (F.col("field") != "latency_ms") & (p <= q - 0.25)
    pct = F.explode(F.array_compact(F.array(case(0, low), case(1, high), case(2, high))))
    return both.select("source_table", "run_id", "field", pct.alias("pct"))


@query()
def p3_run_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles 10, 50 and 90 of every run."""
    runs, _ = _run_and_conf(spark, sf)
    return runs.select(*RUN, *[F.col("p")[i].alias(f"p{x}") for i, x in enumerate(PCTS)])


@query()
def p3_configuration_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The same of every configuration, from its runs' digests by node addition."""
    _, confs = _run_and_conf(spark, sf)
    return confs.select(*CONF, *[F.col("p")[i].alias(f"p{x}") for i, x in enumerate(PCTS)])


# 4. Most similar vectors

DIMS = 64


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "records").select(F.lit("records").alias("space"), "id", "vector")
    pinecone = table(spark, sf, "pinecone_vectors").select(F.concat(F.lit("pinecone_vectors/"), "ns").alias("space"), "id", F.col("vector_values").alias("vector"))
    return vectors.packed_vectors(records.unionByName(pinecone).where("id IS NOT NULL AND space IS NOT NULL"), ["space", "id"], "vector", DIMS)


P4_SQL = """WITH r AS (SELECT DISTINCT 'records' AS s, '' AS ns, id, CAST(vector AS DOUBLE[]) AS v FROM records WHERE len(vector) = 64
  UNION ALL SELECT DISTINCT 'pinecone_vectors', ns, id, CAST(vector_values AS DOUBLE[]) FROM pinecone_vectors WHERE len(vector_values) = 64),
u AS (SELECT * FROM r WHERE id IS NOT NULL AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
c AS (SELECT a.s, a.ns, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.s = b.s AND a.ns = b.ns AND a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY s, ns, a ORDER BY round(c, 7) DESC, b) AS rn FROM c)"""


@query(f"{P4_SQL} SELECT DISTINCT s AS source_table, least(a, b) AS id_a, greatest(a, b) AS id_b FROM t WHERE rn <= 5 AND c >= 0.75")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.nearest(_vectors(spark, sf), DIMS, k=5, least=0.75)
    return near.select(
        F.substring_index("space", "/", 1).alias("source_table"),
        F.least("id", "neighbour").alias("id_a"),
        F.greatest("id", "neighbour").alias("id_b"),
    ).distinct()


@query(f"{P4_SQL} SELECT CASE WHEN s = 'records' THEN s ELSE s || '/' || ns END AS space, a AS id, b AS neighbour FROM t WHERE rn <= 5")
def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar others of every usable vector, whatever their cosine."""
    return neighbours.nearest(_vectors(spark, sf), DIMS, k=5).select("space", "id", "neighbour")


def _unpack():  # noqa: ANN202
    return F.pandas_udf(lambda v: pd.Series([np.frombuffer(x, np.float32) for x in v], dtype=object), T.ArrayType(T.FloatType()))


@query()
def p4_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the five neighbours of one row in twenty (by hash of the id) against brute force
    over all records, and with neighbours of equal cosine counted as equal."""
    packed = vectors.packed_vectors(table(spark, sf, "records").where("id IS NOT NULL").select("id", "vector"), ["id"], "vector", DIMS)
    rows = materialize(packed.distinct(), "unit-vectors")
    near = neighbours.nearest(rows.select(F.lit("").alias("space"), "id", "vec"), DIMS, k=5)
    plain = rows.select("id", _unpack()("vec").alias("vector"))
    asked = plain.where("pmod(xxhash64(id), 20) = 0").select(F.col("id").alias("query_id"), "vector")
    exact = knn.search_batch(plain, asked, 6, "cosine").where("query_id <> id")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    truth = exact.withColumn("n", F.row_number().over(w)).where("n <= 5").groupBy("query_id").agg(F.collect_set("id").alias("want"), F.max("distance").alias("last"))
    got = near.groupBy(F.col("id").alias("query_id")).agg(F.collect_set("neighbour").alias("got"), F.collect_list("cosine").alias("cosines"))
    both = truth.join(got, "query_id", "left")
    hit = F.size(F.array_intersect("want", F.coalesce("got", F.array().cast("array<string>"))))
    tied = F.size(F.filter("cosines", lambda c: c >= 1 - F.col("last") - 1e-6))
    return both.agg(F.count("*").alias("queries"), F.round(F.avg(hit / F.size("want")), 4).alias("recall"), F.round(F.avg(F.least(tied / F.size("want"), F.lit(1.0))), 4).alias("tie_aware_recall"))


# 5. Clusters


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, sf, "records")
    packed = vectors.packed_vectors(records.select("id", "vector").where("id IS NOT NULL"), ["id"], "vector", DIMS)
    found = materialize(clusters.similarity_clusters(packed, DIMS), "clusters")
    now = records.where("routing_epoch = 7 AND cell_ordinal IS NOT NULL").select("id", "cell_ordinal").distinct()
    votes = found.join(now, "id").groupBy("cluster", "cell_ordinal").count()
    cell = votes.groupBy("cluster").agg(F.max_by("cell_ordinal", F.struct("count", -F.col("cell_ordinal"))).alias("cell_ordinal"))
    return found, cell


# By definition instead of bands: components of all pairs of a cosine of 0.75, members near their mean.
@query(
    """WITH RECURSIVE r AS (SELECT id, min(CAST(vector AS DOUBLE[])) AS v FROM records WHERE id IS NOT NULL AND len(vector) = 64
    AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id),
u AS (SELECT id, [x / sqrt(list_inner_product(v, v)) for x in v] AS v FROM r),
e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON list_inner_product(a.v, b.v) >= 0.75),
g AS (SELECT a, b FROM e UNION SELECT g.a, e.b FROM g JOIN e ON e.a = g.b),
c AS (SELECT a AS id, min(b) AS grp FROM g GROUP BY a),
s AS (SELECT grp, i, sum(x) AS x FROM (SELECT grp, unnest(v) AS x, unnest(range(64)) AS i FROM c JOIN u USING (id)) GROUP BY ALL),
m AS (SELECT grp, list(x ORDER BY i) AS m FROM s GROUP BY grp),
k AS (SELECT id, grp, count(*) OVER (PARTITION BY grp) AS n FROM c JOIN u USING (id) JOIN m USING (grp) WHERE list_cosine_similarity(v, m) >= 0.74),
w AS (SELECT grp, cell_ordinal, count(*) AS n FROM k JOIN (SELECT DISTINCT id, cell_ordinal FROM records WHERE routing_epoch = 7 AND cell_ordinal IS NOT NULL) USING (id) WHERE k.n >= 8 GROUP BY ALL),
o AS (SELECT grp, cell_ordinal, row_number() OVER (PARTITION BY grp ORDER BY n DESC, cell_ordinal) AS rn FROM w)
SELECT id, o.cell_ordinal FROM k LEFT JOIN (SELECT * FROM o WHERE rn = 1) o USING (grp) WHERE k.n >= 8"""
)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found, cell = _clusters(spark, sf)
    return found.join(broadcast_if_small(cell, 100_000), "cluster", "left").select("id", "cell_ordinal")


@query()
def p5_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Each cluster with its size, its three most typical members and its cell."""
    found, cell = _clusters(spark, sf)
    w = Window.partitionBy("cluster").orderBy(F.desc("cosine"), "id")
    top = found.withColumn("n", F.row_number().over(w)).where("n <= 3")
    typical = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("typical"))
    size = found.groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg("cosine"), 4).alias("mean_cosine"))
    return size.join(typical, "cluster").join(cell, "cluster", "left").drop("cluster")


@query()
def p5_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Of one record in twenty (by hash of the id), over the clustered ones: the share of its 50 nearest
    others by brute force with a cosine of 0.75 or more that are in its cluster."""
    found, _ = _clusters(spark, sf)
    packed = vectors.packed_vectors(table(spark, sf, "records").where("id IS NOT NULL").select("id", "vector"), ["id"], "vector", DIMS)
    plain = materialize(packed.groupBy("id").agg(F.min("vec").alias("vec")).select("id", _unpack()("vec").alias("vector")), "unit-vectors")
    asked = plain.where("pmod(xxhash64(id), 20) = 0").select(F.col("id").alias("query_id"), "vector")
    near = knn.search_batch(plain, asked, 51, "cosine").where("query_id <> id AND distance <= 0.25").select("query_id", "id")
    of = found.select("id", "cluster")
    both = near.join(of.select(F.col("id").alias("query_id"), F.col("cluster").alias("own")), "query_id").join(of, "id", "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("pairs"), F.round(F.avg((F.col("cluster").eqNullSafe(F.col("own"))).cast("double")), 4).alias("recall"))


# 6. How distinctive a term is


def _enrichment(spark: SparkSession, sf: str, wanted: DataFrame) -> DataFrame:
    return enrichment.enrichment(current_text_rows(spark, sf), wanted, "index_name", "record_id", "terms", "term_id", "tf")


CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"


@query(
    f"""WITH {CURRENT_SQL}, K AS (SELECT index_name, term_id, CAST(sum(tf) AS DOUBLE) AS K FROM post GROUP BY ALL),
M AS (SELECT index_name, CAST(sum(tf) AS DOUBLE) AS M FROM post GROUP BY ALL),
n AS (SELECT index_name, record_id, CAST(sum(tf) AS DOUBLE) AS n FROM post GROUP BY ALL),
w AS (SELECT DISTINCT record_id, index_name FROM term_probes),
x AS (SELECT record_id, index_name, term_id, K, M, n, CAST(unnest(range(tf, CAST(least(n, K) AS BIGINT) + 1)) AS DOUBLE) AS x
  FROM post JOIN w USING (record_id, index_name) JOIN K USING (index_name, term_id) JOIN M USING (index_name) JOIN n USING (index_name, record_id)),
s AS (SELECT record_id, term_id, -ln(sum(exp({CHOOSE.format('K', 'x')} + {CHOOSE.format('(M - K)', '(n - x)')} - {CHOOSE.format('M', 'n')}))) AS surprise
  FROM x WHERE n - x <= M - K GROUP BY ALL)
SELECT record_id, term_id FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(surprise, 6) DESC, term_id) AS rn FROM s) WHERE rn = 1"""
)
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    scored = _enrichment(spark, sf, table(spark, sf, "term_probes"))
    best = F.max_by("term", F.struct("score", "surprise", -F.col("term")))
    return scored.groupBy(F.col("grp"), F.col("rec").alias("record_id")).agg(best.alias("term_id")).select("record_id", "term_id")


@query(
    f"""WITH {CURRENT_SQL}, K AS (SELECT index_name, term_id, CAST(sum(tf) AS DOUBLE) AS K FROM post GROUP BY ALL),
M AS (SELECT index_name, CAST(sum(tf) AS DOUBLE) AS M FROM post GROUP BY ALL),
n AS (SELECT index_name, record_id, CAST(sum(tf) AS DOUBLE) AS n FROM post GROUP BY ALL),
x AS (SELECT record_id, index_name, term_id, K, M, n, CAST(unnest(range(tf, CAST(least(n, K) AS BIGINT) + 1)) AS DOUBLE) AS x
  FROM post JOIN K USING (index_name, term_id) JOIN M USING (index_name) JOIN n USING (index_name, record_id)),
s AS (SELECT index_name, record_id, term_id, -ln(sum(exp({CHOOSE.format('K', 'x')} + {CHOOSE.format('(M - K)', '(n - x)')} - {CHOOSE.format('M', 'n')}))) AS surprise
  FROM x WHERE n - x <= M - K GROUP BY ALL),
j AS (SELECT *, surprise - ln(CAST(count(*) OVER (PARTITION BY index_name, record_id) AS DOUBLE) / row_number() OVER (PARTITION BY index_name, record_id ORDER BY surprise DESC, term_id)) AS adjusted FROM s),
d AS (SELECT index_name, term_id, count(*) AS records FROM post GROUP BY ALL)
SELECT index_name, record_id, term_id, tf AS k, records, round(greatest(0, max(adjusted) OVER (PARTITION BY index_name, record_id ORDER BY surprise DESC, term_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS score
FROM j JOIN post USING (index_name, record_id, term_id) JOIN d USING (index_name, term_id)"""
)
def p6_term_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every term of every record."""
    rows = current_text_rows(spark, sf)
    scored = enrichment.enrichment(rows, rows, "index_name", "record_id", "terms", "term_id", "tf")
    return scored.select(F.col("grp").alias("index_name"), F.col("rec").alias("record_id"), F.col("term").alias("term_id"), "k", "records", F.round("score", 4).alias("score"))


# 7. One ranking from several scores

LEGS = ["dense", "sparse", "late_interaction"]


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    matches = table(spark, sf, "query_matches").where("query_id IS NOT NULL AND id IS NOT NULL")
    asked = table(spark, sf, "hybrid_queries").select("query_id", F.array_distinct("query_terms").alias("query_terms"))
    items = materialize(matches.select("query_id", "id").distinct(), "candidates")
    text = rankfusion.fit(items, asked, current_text_rows(spark, sf)).select("query_id", F.lit("text").alias("leg"), "id", "score")
    scores = matches.select("query_id", "leg", "id", "score").unionByName(text)
    return rankfusion.aggregate_ranks(items, scores, "query_id", "id", "leg", "score", [*LEGS, "text"])


def _beta(k: int) -> str:
    """SQL of P(Beta(k, 5 - k) <= r[k]) for four sorted ranks."""
    terms_ = {1: [(1, 4), (2, 6), (3, 4), (4, 1)], 2: [(2, 6), (3, 4), (4, 1)], 3: [(3, 4), (4, 1)], 4: [(4, 1)]}[k]
    return " + ".join([f"{c} * pow(r[{k}], {j}) * pow(1 - r[{k}], {4 - j})" for j, c in terms_])


P7_SQL = f"""WITH {CURRENT_SQL}, len AS (SELECT index_name, record_id, CAST(sum(tf) AS DOUBLE) AS dl FROM post GROUP BY ALL),
st AS (SELECT index_name, CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM len GROUP BY ALL),
df AS (SELECT index_name, term_id, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY ALL),
c AS (SELECT DISTINCT query_id, id FROM query_matches WHERE query_id IS NOT NULL AND id IS NOT NULL),
qt AS (SELECT DISTINCT query_id, unnest(query_terms) AS term_id FROM hybrid_queries),
f AS (SELECT c.query_id, c.id, sum(ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.2 AS DOUBLE)
    / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))) AS fit
  FROM c JOIN qt USING (query_id) JOIN post ON post.record_id = c.id AND post.term_id = qt.term_id JOIN len USING (index_name, record_id)
  JOIN st USING (index_name) JOIN df ON df.index_name = post.index_name AND df.term_id = post.term_id GROUP BY ALL),
a AS (SELECT query_id, leg, id, min(score) AS score FROM query_matches WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL
  UNION ALL SELECT query_id, 'text', id, -round(fit, 9) FROM f),
k AS (SELECT query_id, leg, id, rank() OVER (PARTITION BY query_id, leg ORDER BY score) + (count(*) OVER (PARTITION BY query_id, leg, score) - 1) / CAST(2 AS DOUBLE) AS rank FROM a),
z AS (SELECT query_id, CAST(count(*) AS DOUBLE) AS z FROM c GROUP BY ALL),
v AS (SELECT c.query_id, c.id, list_sort([coalesce(min(rank) FILTER (leg = 'dense') / z, 1), coalesce(min(rank) FILTER (leg = 'sparse') / z, 1),
    coalesce(min(rank) FILTER (leg = 'late_interaction') / z, 1), coalesce(min(rank) FILTER (leg = 'text') / z, 1)]) AS r
  FROM c JOIN z USING (query_id) LEFT JOIN k USING (query_id, id) GROUP BY c.query_id, c.id, z),
s AS (SELECT query_id, id, least(1, 4 * least({_beta(1)}, {_beta(2)}, {_beta(3)}, {_beta(4)})) AS sig, list_sum(r) AS total FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sig, 12), round(total, 9), id) AS rn FROM s)"""


@query(f"{P7_SQL} SELECT query_id, id FROM o WHERE rn = 1")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    best = F.min_by("id", F.struct(F.round("significance", 12), F.round("mean_rank", 9), "id"))
    return _fused(spark, sf).groupBy("query_id").agg(best.alias("id"))


@query(f"{P7_SQL} SELECT query_id, CAST(rn AS INT) AS position, id, round(sig, 9) AS significance FROM o JOIN (SELECT query_id, top_k FROM hybrid_queries) USING (query_id) WHERE rn <= top_k")
def p7_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The top_k of every hybrid query."""
    w = Window.partitionBy("query_id").orderBy(F.round("significance", 12), F.round("mean_rank", 9), "id")
    ranked = _fused(spark, sf).withColumn("position", F.row_number().over(w))
    k = table(spark, sf, "hybrid_queries").select("query_id", "top_k")
    return ranked.join(k, "query_id").where("position <= top_k").select("query_id", "position", "id", F.round("significance", 9).alias("significance"))


# 8. Evaluation texts leaking into training text


@query()
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "item_id")


@query()
def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per leaked item, in how many documents a passage of it stands, and the length of the longest."""
    found = leakage.passages(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "item_id")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))


# 9. Mixing sources


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = materialize(mixing.sized(table(spark, sf, "documents"), "doc_id", "source", "text"), "sized")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("size"))
    return docs, materialize(mixing.mix_plan(sizes, table(spark, sf, "mix_targets")), "mix-plan")


WORDS_SQL = "len(regexp_extract_all(coalesce(text, ''), '\\S+'))"
SIZES_SQL = f"""s AS (SELECT source, sum(n) AS size FROM (
  SELECT nullif(lower(regexp_replace(source, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')), '') AS source, {WORDS_SQL} AS n FROM documents) WHERE source IS NOT NULL GROUP BY 1),
m AS (SELECT DISTINCT mix_id, source, target_share, max_repeats FROM mix_targets)"""


@query(
    f"""WITH {SIZES_SQL} SELECT mix_id, source FROM m LEFT JOIN s USING (source), (SELECT sum(size) AS total FROM s)
WHERE target_share * total > max_repeats * coalesce(size, 0)"""
)
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    _, plan = _mix(spark, sf)
    return plan.where("short").select("mix_id", "source")


# By closed form instead of rounds: sources in the order of what they can give per share are clamped while that is below the level of the rest.
MIX_SQL = f"""{SIZES_SQL},
t AS (SELECT mix_id, source, target_share, max_repeats, CAST(coalesce(size, 0) AS BIGINT) AS size, CAST(total AS BIGINT) AS total,
    CAST(max_repeats * coalesce(size, 0) AS DOUBLE) AS most FROM m LEFT JOIN s USING (source), (SELECT sum(size) AS total FROM s)),
o AS (SELECT *, most / target_share AS turn, sum(target_share) OVER (PARTITION BY mix_id) AS shares,
    sum(most) OVER w - most AS below, sum(target_share) OVER w - target_share AS taken, row_number() OVER w AS rn
  FROM t WHERE target_share > 0 WINDOW w AS (PARTITION BY mix_id ORDER BY most / target_share, source ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT mix_id, arg_min((shares * total - below) / (shares - taken), rn) AS level FROM o WHERE turn >= (shares * total - below) / (shares - taken) GROUP BY 1),
pl AS (SELECT mix_id, source, target_share, max_repeats, size, target_share * total > most AS short,
    CASE WHEN target_share <= 0 THEN 0 ELSE least(most, coalesce(target_share * level, most)) END AS amount FROM t LEFT JOIN lv USING (mix_id)),
pe AS (SELECT *, CASE WHEN size > 0 THEN amount / size ELSE 0 END AS epochs FROM pl),
dd AS (SELECT doc_id, source, max(n) AS n FROM (
  SELECT doc_id, nullif(lower(regexp_replace(source, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')), '') AS source, {WORDS_SQL} AS n FROM documents)
  WHERE source IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2),
cp AS (SELECT mix_id, doc_id, source, n, CAST(floor(epochs) AS BIGINT)
    + CASE WHEN CAST('0x' || substr(md5('1/' || mix_id || '/' || doc_id), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE) < epochs - floor(epochs) THEN 1 ELSE 0 END AS copies
  FROM dd JOIN pe USING (source) WHERE epochs > 0)"""


@query(
    f"""WITH {MIX_SQL}, us AS (SELECT mix_id, source, CAST(sum(n * copies) AS BIGINT) AS used FROM cp GROUP BY ALL),
al AS (SELECT mix_id, sum(used) AS whole FROM us GROUP BY 1)
SELECT mix_id, source, target_share, max_repeats, size, round(epochs, 6) AS epochs, coalesce(used, 0) AS used,
CASE WHEN whole > 0 THEN round(coalesce(used, 0) / CAST(whole AS DOUBLE), 6) ELSE 0 END AS reached_share, short
FROM pe LEFT JOIN us USING (mix_id, source) LEFT JOIN al USING (mix_id)"""
)
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached shares of every mix, from the documents taken."""
    docs, plan = _mix(spark, sf)
    out = mixing.reached(mixing.composition(docs, plan), plan)
    return out.select("mix_id", "source", "target_share", "max_repeats", "size", F.round("epochs", 6).alias("epochs"), "used", F.round("reached_share", 6).alias("reached_share"), "short")


@query(f"WITH {MIX_SQL} SELECT mix_id, doc_id, source, copies FROM cp WHERE copies > 0")
def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Which document is used how often in which mix."""
    docs, plan = _mix(spark, sf)
    return mixing.composition(docs, plan).select("mix_id", F.col("doc").alias("doc_id"), "source", "copies")


# 10. Keyword-stuffed and link-list pages


@query()
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    scores = stuffing.page_scores(table(spark, sf, "documents"), "doc_id", "text")
    return scores.where(F.col("stuffed") > 2 / 3).select("doc_id").distinct()


@query()
def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The scores of every page."""
    scores = stuffing.page_scores(table(spark, sf, "documents"), "doc_id", "text")
    return scores.select("doc_id", *[F.round(c, 6).alias(c) for c in ("stuffed", "covered", "clauses")])
