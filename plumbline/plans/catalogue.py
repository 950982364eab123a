"""Every registered query of the engine, and SQL that gives the same rows where SQL can.

All queries run over whole tables; every row is a query of the searches. Distances are compared at six
decimals and ties go by id, in both engines. Random state (projections, hyperplanes, codebooks) is seeded data, so
the SQL holds the same numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ingest
from ..config import ForestConfig, GraphConfig, IvfConfig, LshConfig
from ..functions import metrics, text
from ..functions.validation import metadata_problem, vector_problem
from ..operators import clusters, forest, graph, knn, lsh, quantize
from ..operators import table as rows
from ..shared import shared_dir, stage
from ..sources import files
from ..sources.documents import extract_html
from ..streaming.ingest import endpoint, figures
from ..workers import map_arrow

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
K, DIMS = 10, 64


def _query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, vector, label) of the embeddings, as doubles."""
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_ZIP = "list_zip(a.e, b.e)"


def _counted(condition: str) -> str:
    return f"list_sum(list_transform({_ZIP}, lambda x: ({condition})::INT))"


_SQL_METRICS = {
    "cosine": "list_cosine_distance(a.e, b.e)",
    "euclidean": "list_distance(a.e, b.e)",
    "dot_product": "-list_inner_product(a.e, b.e)",
    "manhattan": f"list_sum(list_transform({_ZIP}, lambda x: abs(x[1] - x[2])))",
    "chebyshev": f"list_max(list_transform({_ZIP}, lambda x: abs(x[1] - x[2])))",
    "hamming": _counted("(x[1] > 0) <> (x[2] > 0)"),
    "jaccard": f"1 - CASE WHEN {_counted('x[1] > 0 OR x[2] > 0')} = 0 THEN 1 ELSE {_counted('x[1] > 0 AND x[2] > 0')} / {_counted('x[1] > 0 OR x[2] > 0')} END",
}


def _rounded(expr: str) -> str:
    return f"round({expr}, {knn.DECIMALS})::DOUBLE + 0.0"


def _top(pairs: str, k: int = K) -> str:
    return f"SELECT query_id, rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM {pairs}) WHERE rank <= {k}"


def _pairs(metric: str, join: str = "v a CROSS JOIN v b") -> str:
    return f"p AS (SELECT a.id AS query_id, b.id AS id, {_rounded(_SQL_METRICS[metric])} AS distance FROM {join})"


# -- exact search --


def _knn(metric: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = vectors(spark, d)
        return knn.knn_join(v, v, K, metric)

    return run


for _m in metrics.METRICS:
    _query(f"knn_{_m.removesuffix('_product')}", f"WITH {_V}, {_pairs(_m)} {_top('p')}")(_knn(_m))


@_query("knn_nearest_other", f"WITH {_V}, {_pairs('cosine', 'v a JOIN v b ON a.id <> b.id')} {_top('p', 1)}")
def nearest_other(spark, d):
    v = vectors(spark, d)
    return knn.knn_join(v, v, 1, rule="others")


@_query("knn_filtered_by_label", f"WITH {_V}, {_pairs('cosine', 'v a JOIN v b ON b.label = 3')} {_top('p')}")
def filtered(spark, d):
    v = vectors(spark, d)
    return knn.knn_join(v, v.where("label = 3"), K)


@_query("similarity_matrix", f"WITH {_V} SELECT a.id AS a, b.id AS b, {_rounded('list_cosine_similarity(a.e, b.e)')} AS similarity FROM v a CROSS JOIN v b")
def matrix(spark, d):
    v = vectors(spark, d)
    return knn.similarity_matrix(v, v)


@_query("knn_similarity", f"WITH {_V}, p AS (SELECT a.id AS query_id, b.id AS id, {_rounded(_SQL_METRICS['cosine'])} AS distance FROM v a CROSS JOIN v b), t AS ({_top('p')}) SELECT query_id, rank, id, round(1 - distance, 6) + 0.0 AS similarity FROM t")
def knn_similarity(spark, d):
    """Results as similarities, 1 - distance."""
    return _knn("cosine")(spark, d).select("query_id", "rank", "id", (F.round(1 - F.col("distance"), 6) + 0.0).alias("similarity"))


@_query("anomaly_threshold", f"WITH {_V}, {_pairs('cosine', 'v a JOIN v b ON a.id <> b.id')} SELECT query_id AS id, min(distance) AS distance FROM p GROUP BY query_id HAVING min(distance) > 0.5")
def anomaly(spark, d):
    return knn.anomalies(vectors(spark, d), 0.5)


@_query(
    "metric_pairs",
    f"WITH {_V}, p AS (SELECT a.id, " + ", ".join(f"{_rounded(s)} AS {m}" for m, s in _SQL_METRICS.items()) + " FROM v a JOIN v b ON b.id = a.id + 1) SELECT * FROM p",
)
def metric_pairs(spark, d):
    """All metrics as column expressions, on each row and its successor."""
    v = vectors(spark, d)
    pairs = v.select("id", F.col("vector").alias("x")).join(v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("y")), "id")
    return pairs.select("id", *[(F.round(metrics.distance(m, F.col("x"), F.col("y")), knn.DECIMALS) + 0.0).alias(m) for m in metrics.METRICS])


_NORMS = {"l1": "list_sum(list_transform(e, lambda x: abs(x)))", "l2": "sqrt(list_inner_product(e, e))", "max": "list_max(list_transform(e, lambda x: abs(x)))"}


def _normalized(kind: str) -> Query:
    return lambda spark, d: vectors(spark, d).select("id", F.posexplode(metrics.normalize(F.col("vector"), kind)).alias("pos", "x")).select("id", "pos", (F.round("x", 6) + 0.0).alias("x"))


for _k, _n in _NORMS.items():
    _query(f"normalize_{_k}", f"WITH {_V}, n AS (SELECT id, e, {_n} AS n FROM v) SELECT id, (generate_subscripts(e, 1) - 1)::INT AS pos, {_rounded('unnest(e) / n')} AS x FROM n")(_normalized(_k))


@_query("vector_norms", f"WITH {_V} SELECT id, {_rounded(_NORMS['l2'])} AS norm FROM v")
def vector_norms(spark, d):
    return vectors(spark, d).select("id", F.round(metrics.norm(F.col("vector")), 6).alias("norm"))


# -- inverted lists --

PROBES, WIDE_PROBES = 3, 8


def label_centroids(spark: SparkSession, d: str) -> list[list[float]]:
    """The mean vector of each label, in label order: one row per label comes back."""
    means = F.array(*[F.round(F.avg(F.col("vector")[i]), 6) for i in range(DIMS)])
    return [r["c"] for r in vectors(spark, d).groupBy("label").agg(means.alias("c")).orderBy("label").collect()]


_CENTRES = f"""{_V}, flat AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
centres AS (SELECT (row_number() OVER (ORDER BY label) - 1)::INT AS cluster_id, list(m ORDER BY i) AS e FROM
            (SELECT label, i, round(avg(x), 6) AS m FROM flat GROUP BY label, i) GROUP BY label),
near AS (SELECT a.id, b.cluster_id, row_number() OVER (PARTITION BY a.id ORDER BY {_rounded(_SQL_METRICS['cosine'])}, b.cluster_id) AS r FROM v a CROSS JOIN centres b)"""


@_query("ivf_assign", f"WITH {_CENTRES} SELECT id, cluster_id FROM near WHERE r = 1")
def ivf_assign(spark, d):
    return clusters.assign(vectors(spark, d), label_centroids(spark, d)).select("id", "cluster_id")


@_query(
    "ivf_cluster_stats",
    f"WITH {_CENTRES}, s AS (SELECT cluster_id, count(*) AS n FROM near WHERE r = 1 GROUP BY cluster_id) "
    "SELECT count(*) AS non_empty, sum(n)::BIGINT AS vectors, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS avg_size FROM s",
)
def ivf_stats(spark, d):
    return clusters.cluster_stats(clusters.assign(vectors(spark, d), label_centroids(spark, d)))


_IVF = f"""{_CENTRES}, home AS (SELECT v.id, v.e, n.cluster_id FROM v JOIN near n ON v.id = n.id AND n.r = 1),
probes AS (SELECT v.id, v.e, n.cluster_id FROM v JOIN near n ON v.id = n.id AND n.r <= {PROBES}),
p AS (SELECT a.id AS query_id, b.id AS id, {_rounded(_SQL_METRICS['cosine'])} AS distance FROM probes a JOIN home b USING (cluster_id))"""


@_query("ivf_search", f"WITH {_IVF} {_top('p')}")
def ivf_search(spark, d):
    v, c = vectors(spark, d), label_centroids(spark, d)
    return clusters.ivf_search(v, clusters.assign(v, c), c, K, PROBES)


@_query("ivf_search_wide")
def ivf_wide(spark, d):
    """With the least number of probes that has a recall of 0.9. Held against brute force, so there is no SQL."""
    v, c = vectors(spark, d), label_centroids(spark, d)
    return clusters.ivf_search(v, clusters.assign(v, c), c, K, WIDE_PROBES)


def _recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Each side is read once: it may be a search."""
    pair = ["query_id", "id"]
    hits, wanted = (x.groupBy(pair).agg(F.count("*").alias(n)) for x, n in ((found, "h"), (exact, "w")))
    both = wanted.join(hits, pair, "left").agg(F.coalesce(F.sum(F.col("h") * F.col("w")), F.lit(0)).alias("hits"), F.coalesce(F.sum("w"), F.lit(0)).alias("wanted"))
    return both.select("hits", "wanted", F.round(F.col("hits") / F.col("wanted"), 6).alias("recall"))


def _recall_sql(ctes: str) -> str:
    return f"""WITH {ctes}, f AS ({_top('p')}), q AS (SELECT a.id AS query_id, b.id AS id, {_rounded(_SQL_METRICS['cosine'])} AS distance FROM v a CROSS JOIN v b), x AS ({_top('q')})
SELECT h.hits, w.wanted, round(h.hits / w.wanted, 6) AS recall FROM (SELECT count(*) AS hits FROM x JOIN f USING (query_id, id)) h, (SELECT count(*) AS wanted FROM x) w"""


@_query("recall_at_10_ivf", _recall_sql(_IVF))
def recall_ivf(spark, d):
    return _recall(ivf_search(spark, d), _knn("cosine")(spark, d))


@_query("kmeans_trained")
def kmeans(spark, d):
    """Lloyd's algorithm for cosine distance; the seeds are random, so there is no SQL."""
    v = vectors(spark, d)
    return clusters.cluster_stats(clusters.assign(v, clusters.train(v, IvfConfig(num_clusters=16, num_probes=4)), "cosine"))


# -- hashing --


def _numbers(values) -> str:
    return "[" + ", ".join(map(repr, values)) + "]::DOUBLE[]"


def _lsh_sql(config: LshConfig) -> str:
    p, offsets = lsh.projections(config, DIMS)
    planes = ", ".join(f"({t}, {b}, {_numbers(p[t][b])}, {offsets[t][b]!r})" for t in range(config.num_tables) for b in range(config.num_bits))
    dot = "list_inner_product(v.e, planes.h)"
    bit = f"((floor(({dot} + planes.o) / {config.bucket_width})::BIGINT % 2) + 2) % 2" if config.metric == "euclidean" else f"({dot} >= 0)::BIGINT"
    return f"""{_V}, planes(t, b, h, o) AS (VALUES {planes}),
buckets AS (SELECT v.id, t::INT AS table_no, sum({bit} * (1::BIGINT << ({config.num_bits - 1} - b)::BIGINT))::BIGINT AS bucket FROM v CROSS JOIN planes GROUP BY v.id, t)"""


FLIPS = 3
LSH, LSH_EUCLIDEAN = LshConfig(), LshConfig(metric="euclidean", bucket_width=0.5)


@_query("lsh_buckets", f"WITH {_lsh_sql(LSH)} SELECT table_no, bucket, id FROM buckets")
def lsh_buckets(spark, d):
    return lsh.buckets(vectors(spark, d), LSH, DIMS)


@_query("lsh_euclidean_buckets", f"WITH {_lsh_sql(LSH_EUCLIDEAN)} SELECT table_no, bucket, id FROM buckets")
def lsh_euclidean_buckets(spark, d):
    return lsh.buckets(vectors(spark, d), LSH_EUCLIDEAN, DIMS)


@_query(
    "lsh_bucket_stats",
    f"WITH {_lsh_sql(LSH)}, s AS (SELECT count(*) AS n FROM buckets GROUP BY table_no, bucket) "
    f"SELECT {LSH.num_tables * 2**LSH.num_bits}::BIGINT AS total_buckets, count(*) AS non_empty, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS avg_size FROM s",
)
def lsh_stats(spark, d):
    return lsh.bucket_stats(lsh.buckets(vectors(spark, d), LSH, DIMS), LSH)


_LSH = f"""{_lsh_sql(LSH)}, c AS (SELECT DISTINCT x.id AS query_id, y.id FROM buckets x JOIN buckets y USING (table_no, bucket)),
p AS (SELECT c.query_id, c.id, {_rounded(_SQL_METRICS['cosine'])} AS distance FROM c JOIN v a ON a.id = c.query_id JOIN v b ON b.id = c.id)"""


@_query("lsh_search", f"WITH {_LSH} {_top('p')}")
def lsh_search(spark, d):
    v = vectors(spark, d)
    return lsh.lsh_search(v, v, LSH, DIMS, K)


@_query("lsh_search_multiprobe")
def lsh_multiprobe(spark, d):
    """Neighbouring buckets too: FLIPS is the least with a recall of 0.9. Held against brute force, so there is no SQL."""
    v = vectors(spark, d)
    return lsh.lsh_search(v, v, LSH, DIMS, K, flips=FLIPS)


@_query("recall_at_10_lsh", _recall_sql(_LSH))
def recall_lsh(spark, d):
    return _recall(lsh_search(spark, d), _knn("cosine")(spark, d))


# -- graph --

GRAPH = GraphConfig()

_EDGES = f"""{_V}, nodes AS (SELECT *, least({graph.TOP_LEVEL}, bit_count(((id + 1) & -(id + 1)) - 1))::INT AS level FROM v),
d AS (SELECT a.id AS x, b.id AS y, a.level AS lx, b.level AS ly, {_rounded(_SQL_METRICS['cosine'])} AS distance FROM nodes a CROSS JOIN nodes b),
near AS (SELECT l::INT AS level, x, y, row_number() OVER (PARTITION BY l, x ORDER BY distance, y) AS r FROM d, range({graph.TOP_LEVEL + 1}) t(l) WHERE y < x AND lx >= l AND ly >= l),
edges AS (SELECT level, x AS src, y AS dst FROM near WHERE r <= {GRAPH.m} UNION ALL SELECT level, y, x FROM near WHERE r <= {GRAPH.m})"""


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = vectors(spark, d)
    g = graph.nodes(v)
    return v, g, graph.edges(g, GRAPH)


@_query("hnsw_edges", f"WITH {_EDGES} SELECT level, src, dst FROM edges")
def hnsw_edges(spark, d):
    return _linked(spark, d)[2]


@_query("hnsw_stats", f"WITH {_EDGES} SELECT t.l::INT AS level, count(*) AS nodes, (SELECT count(*) FROM edges e WHERE e.level = t.l) AS edges FROM nodes, range({graph.TOP_LEVEL + 1}) t(l) WHERE nodes.level >= t.l GROUP BY t.l")
def hnsw_stats(spark, d):
    _, g, e = _linked(spark, d)
    return graph.graph_stats(g, e)


def _walk_sql() -> str:
    parts = [f"b{graph.TOP_LEVEL + 1} AS (SELECT id AS q, (SELECT id FROM nodes ORDER BY level DESC, id LIMIT 1) AS id FROM v)"]
    for level in range(graph.TOP_LEVEL, 0, -1):
        b = f"b{level + 1}"
        parts.append(f"r{level} AS (SELECT DISTINCT {b}.q, e.dst AS id FROM {b} JOIN edges e ON e.src = {b}.id AND e.level = {level})")
        parts.append(f"k{level} AS (SELECT * FROM r{level} UNION ALL SELECT q, id FROM {b} WHERE q NOT IN (SELECT q FROM r{level}))")
        parts.append(f"b{level} AS (SELECT q, id FROM (SELECT k.q, k.id, row_number() OVER (PARTITION BY k.q ORDER BY d.distance, k.id) AS r FROM k{level} k JOIN d ON d.x = k.q AND d.y = k.id) WHERE r <= {GRAPH.ef_search})")
    parts.append("c AS (SELECT q, id FROM b1 UNION SELECT b1.q, e.dst FROM b1 JOIN edges e ON e.src = b1.id AND e.level = 0)")
    parts.append("p AS (SELECT c.q AS query_id, c.id, d.distance FROM c JOIN d ON d.x = c.q AND d.y = c.id)")
    return ",\n".join(parts)


@_query("hnsw_search", f"WITH {_EDGES},\n{_walk_sql()} {_top('p')}")
def hnsw_search(spark, d):
    v, g, e = _linked(spark, d)
    return graph.graph_search(v, stage(g, "nodes"), stage(e, "edges"), GRAPH, K)


# -- forest --

FOREST = ForestConfig()


@_query("annoy_leaves")
def annoy_leaves(spark, d):
    """The leaves of the whole forest, at full depth. Planes exist for the paths that rows take only, so there is no SQL; a test has the brute force."""
    return forest.leaves(vectors(spark, d), FOREST, DIMS)


@_query("annoy_tree_stats")
def annoy_stats(spark, d):
    return forest.tree_stats(annoy_leaves(spark, d))


@_query("annoy_search")
def annoy_search(spark, d):
    """Best-first over a priority queue: sequential per query, so there is no SQL."""
    v = vectors(spark, d)
    return forest.forest_search(v, v, stage(forest.leaves(v, FOREST, DIMS), "leaves"), FOREST, DIMS, K)


# -- quantizers --

BITS = 8
_PARAMS = f"""{_V}, flat AS (SELECT id, unnest(e) AS x, (generate_subscripts(e, 1) - 1)::INT AS pos FROM v),
params AS (SELECT pos, min(x) AS low, max(x) AS high FROM flat GROUP BY pos),
codes AS (SELECT id, pos, low, CASE WHEN high > low THEN (high - low) / {2**BITS - 1} ELSE 1.0 END AS scale,
          greatest(0, least({2**BITS - 1}, floor((x - low) / CASE WHEN high > low THEN (high - low) / {2**BITS - 1} ELSE 1.0 END + 0.5)))::INT AS code FROM flat JOIN params USING (pos))"""


@_query("sq_params", f"WITH {_PARAMS} SELECT pos, {_rounded('low')} AS low, {_rounded('high')} AS high FROM params")
def sq_params(spark, d):
    return quantize.ScalarQuantizer.params(vectors(spark, d), DIMS).select("pos", (F.round("low", 6) + 0.0).alias("low"), (F.round("high", 6) + 0.0).alias("high"))


@_query("sq_codes", f"WITH {_PARAMS} SELECT id, pos, code FROM codes")
def sq_codes(spark, d):
    v = vectors(spark, d)
    return v.select("id", F.posexplode(quantize.ScalarQuantizer.train(v, DIMS, BITS).encode(F.col("vector"))).alias("pos", "code"))


@_query(
    "sq_distance",
    f"WITH {_PARAMS}, back AS (SELECT id, list(code * scale + low ORDER BY pos) AS e FROM codes GROUP BY id) SELECT a.id, {_rounded(f'greatest(0, {_SQL_METRICS["cosine"]})')} AS distance FROM v a JOIN back b USING (id)",
)
def sq_distance(spark, d):
    v = vectors(spark, d)
    q = quantize.ScalarQuantizer.train(v, DIMS, BITS)
    return v.select("id", (F.round(q.distance(F.col("vector"), q.encode(F.col("vector"))), 6) + 0.0).alias("distance"))


PARTS, WORDS = 8, 16
CODEBOOKS = np.random.default_rng(7).normal(0, 0.125, (PARTS, WORDS, DIMS // PARTS)).round(6).tolist()
_BOOKS = ", ".join(f"({m}, {w}, {_numbers(CODEBOOKS[m][w])})" for m in range(PARTS) for w in range(WORDS))
_W = DIMS // PARTS
_PQ = f"""{_V}, books(m, code, w) AS (VALUES {_BOOKS}),
luts AS (SELECT v.id, m, code, list_sum(list_transform(list_zip(v.e[m * {_W} + 1 : (m + 1) * {_W}], w), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM v CROSS JOIN books),
codes AS (SELECT id, m, code FROM (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY round(d, 9), code) AS r FROM luts) WHERE r = 1)"""


@_query("pq_codes", f"WITH {_PQ} SELECT id, m::INT AS part, code::INT AS code FROM codes")
def pq_codes(spark, d):
    return vectors(spark, d).select("id", F.posexplode(quantize.ProductQuantizer(CODEBOOKS).encode(F.col("vector"))).alias("part", "code"))


@_query("pq_adc_top_k", f"WITH {_PQ}, p AS (SELECT l.id AS query_id, c.id, {_rounded('sqrt(sum(l.d))')} AS distance FROM luts l JOIN codes c USING (m, code) GROUP BY l.id, c.id) {_top('p')}")
def pq_search(spark, d):
    v, q = vectors(spark, d), quantize.ProductQuantizer(CODEBOOKS)
    return q.search(v, q.encoded(v), K)


@_query("pq_trained")
def pq_trained(spark, d):
    """Codebooks of production size, trained by k-means, and the error of the round trip; the seeds are random, so there is no SQL."""
    v = vectors(spark, d)
    q = quantize.ProductQuantizer.train(v, DIMS, PARTS)
    books = q.codebooks
    back = v.select("id", "vector").join(q.encoded(v), "id")

    def error(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            code = np.asarray(b.column(2).flatten()).reshape(b.num_rows, PARTS)
            y = np.concatenate([np.array(books[m])[code[:, m]] for m in range(PARTS)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(np.sqrt(((x - y) ** 2).sum(1)), 6))], ["id", "error"])

    return map_arrow(back.select("id", "vector", "codes"), error, "id bigint, error double")


@_query("pq_search_reranked")
def pq_reranked(spark, d):
    """Codebooks trained on all rows, and a candidate list settled by true distances. Held against brute force (recall), so there is no SQL."""
    v = vectors(spark, d)
    q = quantize.ProductQuantizer.train(v, DIMS, PARTS)
    return q.search_reranked(v, v, stage(q.encoded(v), "codes"), K)


# -- rows --


def _base(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("id", "vector", F.concat(F.lit('{"label":'), F.col("label").cast("string"), F.lit("}")).alias("metadata"))


_ROWS = f"{_V}, base AS (SELECT id, e, '{{\"label\":' || label || '}}' AS metadata FROM v)"


@_query("delete_antijoin", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def deleted(spark, d):
    """The embeddings without those whose id is labelled."""
    return rows.delete(_base(spark, d), _table(spark, d, "labels").select(F.col("doc_id").alias("id"))).select("id")


@_query(
    "update_coalesce",
    f"WITH {_ROWS}, c AS (SELECT doc_id AS id, min(quality) AS q FROM labels GROUP BY doc_id) "
    "SELECT base.id, CASE WHEN c.id IS NULL THEN metadata WHEN c.q = 1 THEN '{\"quality\":1}' END AS metadata, round(e[1], 6) + 0.0 AS first FROM base LEFT JOIN c USING (id)",
)
def updated(spark, d):
    """Labels as changes: the vector stays, metadata is replaced, for quality 0 by null."""
    changes = _table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q"))
    changes = changes.select("id", F.lit(None).cast("array<double>").alias("vector"), F.when(F.col("q") == 1, '{"quality":1}').alias("metadata"))
    return rows.update(_base(spark, d), changes).select("id", "metadata", (F.round(F.col("vector")[0], 6) + 0.0).alias("first"))


@_query("upsert", "WITH n AS (SELECT coalesce(max(vec_id), 0) AS m FROM embeddings) SELECT vec_id AS id, 'old' AS origin FROM embeddings WHERE vec_id < (SELECT (m + 1) // 2 FROM n) UNION ALL SELECT vec_id + (SELECT (m + 1) // 2 FROM n), 'new' FROM embeddings")
def upserted(spark, d):
    """The table and itself shifted by half: the shifted rows win."""
    base = _base(spark, d)
    half = F.expr("(m + 1) div 2")
    m = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    new = base.crossJoin(F.broadcast(m)).select((F.col("id") + half).alias("id"), "vector", F.lit("new").alias("metadata"))
    return rows.upsert(base.withColumn("metadata", F.lit("old")), new).select("id", F.col("metadata").alias("origin"))


@_query("page_keyset", "SELECT vec_id AS id FROM embeddings WHERE vec_id > 99 ORDER BY vec_id LIMIT 50")
def page_keyset(spark, d):
    return rows.keyset_page(_base(spark, d), 50, 99)[0].select("id")


@_query("page_offset", "SELECT vec_id AS id FROM embeddings ORDER BY vec_id LIMIT 20 OFFSET 40")
def page_offset(spark, d):
    return rows.offset_page(_base(spark, d), 3, 20).select("id")


@_query("page_info", "SELECT 3 AS page, 20 AS size, count(*) AS total, ceil(count(*) / 20)::BIGINT AS pages, ceil(count(*) / 20) > 3 AS has_next, true AS has_previous FROM embeddings")
def page_info(spark, d):
    return rows.page_info(_base(spark, d), 3, 20)


@_query("point_lookup", f"WITH {_ROWS} SELECT id, metadata, round(e[1], 6) + 0.0 AS first FROM base WHERE id = 42")
def point_lookup(spark, d):
    return _base(spark, d).where("id = 42").select("id", "metadata", (F.round(F.col("vector")[0], 6) + 0.0).alias("first"))


@_query("update_flags", "SELECT doc_id AS id, doc_id IN (SELECT vec_id FROM embeddings) AS updated FROM labels")
def update_flags(spark, d):
    return rows.update_flags(_base(spark, d), _table(spark, d, "labels").select(F.col("doc_id").alias("id")))


def _beside(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


_TRIP = f"WITH {_ROWS} SELECT id::VARCHAR AS id, label::VARCHAR AS label, len(e)::INT AS dims, round(list_sum(e), 6) + 0.0 AS total FROM v"


def _figures_of(df: DataFrame) -> DataFrame:
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return df.select("id", F.col("metadata")["label"].alias("label"), F.size("vector").alias("dims"), (F.round(total, 6) + 0.0).alias("total"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).withColumn("id", F.col("id").cast("string"))


@_query("json_round_trip", _TRIP)
def json_trip(spark, d):
    """All rows exported as JSON lines and imported again."""
    to = _beside(spark, "json")
    files.write_json(_named(spark, d), to)
    return _figures_of(files.read_json_lines(spark, to))


@_query("csv_round_trip", _TRIP)
def csv_trip(spark, d):
    to = _beside(spark, "csv")
    files.write_csv(_named(spark, d), to)
    return _figures_of(files.read_export(spark, to))


@_query("snapshot_round_trip", f"WITH {_ROWS} SELECT id::VARCHAR AS id, metadata, len(e)::INT AS dims FROM base")
def snapshot_trip(spark, d):
    to = _beside(spark, "snapshot")
    files.save_snapshot(_named(spark, d), to, {"version": 1}, True)
    return files.load_snapshot(spark, to)[0].select("id", "metadata", F.size("vector").alias("dims"))


@_query("table_life", "SELECT vec_id::VARCHAR AS id, CASE WHEN label = 3 THEN '{\"label\":\"three\"}' ELSE '{\"label\":' || label || '}' END AS metadata FROM embeddings WHERE label <> 7")
def table_life(spark, d):
    """A versioned table through insert, update and delete, and what it then has."""
    table = rows.VectorTable(spark, _beside(spark, "table"))
    own = _named(spark, d)
    table.insert(own)
    table.update(own.where("metadata = '{\"label\":3}'").select("id", F.lit(None).cast("array<double>").alias("vector"), F.lit('{"label":"three"}').alias("metadata")))
    table.delete(own.where("metadata = '{\"label\":7}'").select("id"))
    return table.read().select("id", "metadata")


@_query("storage_stats", f"WITH {_ROWS} SELECT count(*) AS vectors, sum(len(e) * 8 + strlen(metadata))::BIGINT AS bytes, min(len(e))::INT AS min_dimensions, max(len(e))::INT AS max_dimensions FROM base")
def storage_stats(spark, d):
    return rows.storage_stats(_base(spark, d))


@_query(
    "validate_metadata",
    "SELECT doc_id, CASE WHEN length(source) > 10000 OR length(text) > 10000 THEN 'long value' ELSE 'ok' END AS verdict FROM documents WHERE text IS NOT NULL AND source IS NOT NULL",
)
def validated_metadata(spark, d):
    docs = _table(spark, d, "documents").where("text is not null and source is not null")
    meta = F.create_map(F.lit("source"), "source", F.lit("text"), "text")
    return docs.select("doc_id", F.coalesce(metadata_problem(meta), F.lit("ok")).alias("verdict"))


@_query("validate_vectors", f"WITH {_V} SELECT id, CASE WHEN e IS NULL THEN 'null' WHEN len(e) = 0 THEN 'empty' WHEN len(e) <> {DIMS} THEN 'wrong length' WHEN list_sum(list_transform(e, lambda x: (NOT isfinite(x))::INT)) > 0 THEN 'not finite' ELSE 'ok' END AS verdict FROM v")
def validated(spark, d):
    return vectors(spark, d).select("id", F.coalesce(vector_problem(F.col("vector"), DIMS), F.lit("ok")).alias("verdict"))


# -- text --


@_query(
    "text_counts",
    "SELECT doc_id, length(text)::INT AS characters, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::INT AS words, CASE WHEN text = '' THEN 0 ELSE (length(text) - length(replace(text, chr(10), '')) + 1) END::INT AS lines FROM documents",
)
def text_counts(spark, d):
    return text.text_counts(_table(spark, d, "documents"))


SIZE, OVERLAP = 512, 128


def _chunks_sql(size: int, overlap: int) -> str:
    return f"""started AS (SELECT doc_id, text, unnest(range(0, length(text), {size - overlap})) AS s FROM documents WHERE length(text) > 0),
chunks AS (SELECT doc_id, (s // {size - overlap})::INT AS chunk_index, s::INT AS start, least(s + {size}, length(text))::INT AS "end", substr(text, s + 1, {size}) AS chunk FROM started)"""


@_query("chunk_fixed", f'WITH {_chunks_sql(SIZE, OVERLAP)} SELECT doc_id, chunk_index, start, "end", chunk FROM chunks')
def chunk_fixed(spark, d):
    return text.chunk_fixed(_table(spark, d, "documents"), SIZE, OVERLAP)


@_query("chunk_sentences")
def chunk_sentences(spark, d):
    """Needs look-behind and greedy packing with overlap, so there is no SQL."""
    return text.chunk_sentences(_table(spark, d, "documents"))


@_query("chunk_paragraphs")
def chunk_paragraphs(spark, d):
    """Conversations as texts of several paragraphs; packing is greedy, so there is no SQL."""
    turns = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return text.chunk_paragraphs(turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text")), id_col="conv_id")


_PARAGRAPHS = r"""WITH RECURSIVE t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id),
raw AS (SELECT conv_id, unnest(p) AS p, generate_subscripts(p, 1) AS pos FROM (SELECT conv_id, string_split_regex(text, '\n[ \t\n\v\f\r]*\n+') AS p FROM t)),
stripped AS (SELECT conv_id, pos, regexp_replace(p, '^\s+|\s+$', '', 'g') AS s FROM raw),
lengthy AS (SELECT conv_id, pos, s FROM stripped WHERE length(s) >= 10
         UNION ALL SELECT conv_id, 1, regexp_replace(text, '^\s+|\s+$', '', 'g') FROM t WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 10 AND conv_id NOT IN (SELECT conv_id FROM stripped WHERE length(s) >= 10)),
kept AS (SELECT conv_id, s, length(s) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM lengthy),
packed AS (SELECT conv_id, i, 0 AS chunk, n AS size FROM kept WHERE i = 1
           UNION ALL SELECT k.conv_id, k.i, p.chunk + (p.size + k.n > 2000)::INT, CASE WHEN p.size + k.n > 2000 THEN k.n ELSE p.size + k.n + 2 END FROM packed p JOIN kept k ON k.conv_id = p.conv_id AND k.i = p.i + 1)
SELECT conv_id, chunk::INT AS chunk_index, string_agg(s, chr(10) || chr(10) ORDER BY i) AS chunk, count(*)::INT AS parts FROM packed JOIN kept USING (conv_id, i) GROUP BY conv_id, packed.chunk"""


@_query("paragraph_chunk_texts", _PARAGRAPHS)
def paragraph_texts(spark, d):
    """The same chunks without their places in the text, which SQL can't follow."""
    return chunk_paragraphs(spark, d).select("conv_id", "chunk_index", "chunk", "parts")


def _terms_sql(source: str, ident: str, column: str, out: str) -> str:
    """(doc, term, n, total) of a relation."""
    return f"""{out}_t AS (SELECT {ident} AS doc, {column} AS txt, string_split_regex(lower({column}), '[\\W_]+') AS t FROM {source}),
{out}_k AS (SELECT doc, CASE WHEN len(t) > 1 AND t[-1] = '' THEN t[:-2] ELSE t END AS t, txt FROM {out}_t),
{out}_w AS (SELECT doc, len(t) AS total, unnest(t) AS term FROM {out}_k),
{out} AS (SELECT doc, term, count(*) AS n, any_value(total) AS total FROM {out}_w WHERE term <> '' GROUP BY doc, term)"""


def _vocabulary_sql(source: str, terms: str, out: str, size: int = 10_000) -> str:
    return f"{out} AS (SELECT term, sum(n)::BIGINT AS n, count(*) AS df, ln((SELECT count(*) FROM {source}) / count(*)) AS idf FROM {terms} GROUP BY term ORDER BY n DESC, term LIMIT {size})"


def _weights_sql(terms: str, vocabulary: str, out: str) -> str:
    return f"""{out}_r AS (SELECT doc, term, f.n / total * idf AS w FROM {terms} f JOIN {vocabulary} USING (term) WHERE idf <> 0),
{out} AS (SELECT doc, term, w / size AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc)) AS size FROM {out}_r) WHERE size >= 1e-10)"""


_TERMS = _terms_sql("documents", "doc_id", "text", "f")


@_query("tfidf_vocabulary", f"WITH {_TERMS}, {_vocabulary_sql('documents', 'f', 'vocab')} SELECT term, n, df, round(idf, 6) + 0.0 AS idf FROM vocab")
def tfidf_vocabulary(spark, d):
    return text.tfidf_vocabulary(_table(spark, d, "documents")).select("term", "n", "df", (F.round("idf", 6) + 0.0).alias("idf"))


@_query("tfidf_weights", f"WITH {_TERMS}, {_vocabulary_sql('documents', 'f', 'vocab')}, {_weights_sql('f', 'vocab', 'w')} SELECT doc AS doc_id, term, round(weight, 6) + 0.0 AS weight FROM w")
def tfidf_weights(spark, d):
    docs = _table(spark, d, "documents")
    return text.tfidf_weights(docs, text.tfidf_vocabulary(docs)).select(F.col("doc").alias("doc_id"), "term", (F.round("weight", 6) + 0.0).alias("weight"))


_RETRIEVE = f"""{_chunks_sql(SIZE, OVERLAP)}, named AS (SELECT doc_id || '_' || chunk_index AS chunk_id, chunk FROM chunks),
{_terms_sql('named', 'chunk_id', 'chunk', 'f')}, {_vocabulary_sql('named', 'f', 'vocab')}, {_weights_sql('f', 'vocab', 'w')},
{_terms_sql('benchmark', 'item_id', 'text', 'g')}, {_weights_sql('g', 'vocab', 'u')},
p AS (SELECT u.doc AS query_id, w.doc AS chunk_id, round(sum(u.weight * w.weight), 6) AS similarity FROM u JOIN w USING (term) GROUP BY u.doc, w.doc),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INT AS rank FROM p)
SELECT query_id, rank, chunk_id, similarity, substr(chunk, 1, 200) AS preview FROM r JOIN named USING (chunk_id) WHERE rank <= 3"""


@_query("rag_top_k", f"WITH {_RETRIEVE}")
def rag(spark, d):
    return text.retrieve(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


_EMBED, _SHORT = 1000, (500, 50)
_INGEST = f"""{_chunks_sql(*_SHORT)}, named AS (SELECT doc_id || '_' || chunk_index AS chunk_id, * FROM chunks),
{_terms_sql('named', 'chunk_id', 'chunk', 'f')}, {_vocabulary_sql('named', 'f', 'vocab', _EMBED)}, {_weights_sql('f', 'vocab', 'w')},
s AS (SELECT doc, count(*) AS n, sum(weight) AS total FROM w GROUP BY doc)"""


@_query("ingest_documents", f"WITH {_INGEST} SELECT chunk_id, doc_id, chunk_index, length(chunk)::INT AS chunk_size, 'fixed' AS strategy, coalesce(s.n, 0)::INT AS terms, round(coalesce(s.total, 0), 6) + 0.0 AS total FROM named LEFT JOIN s ON s.doc = chunk_id")
def ingest_documents(spark, d):
    """Documents chunked and embedded as they go into a table: the chunks, and a figure of each one's vector."""
    own = ingest.embedded_chunks(_table(spark, d, "documents"), ingest.TfidfEmbedder(_EMBED), ingest.Chunking("fixed", *_SHORT))
    # the zeros go first, by compiled code: of a thousand numbers a few dozen are left to add up
    own = own.withColumn("vector", F.array_remove("vector", 0.0))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return own.select("chunk_id", "doc_id", "chunk_index", "chunk_size", "strategy", F.size("vector").alias("terms"), (F.round(total, 6) + 0.0).alias("total"))


@_query("html_extract")
def html_extract(spark, d):
    """A lenient HTML parser: no SQL."""
    return extract_html(_table(spark, d, "pages")).drop("meta", "h1")


# -- request figures --


@_query(
    "metrics_by_endpoint",
    """WITH r AS (SELECT regexp_replace('/api/' || event_type || '/' || user_id, '/[0-9]+$', '/:id') AS endpoint, value, (event_type = 'error')::INT AS f FROM events)
SELECT endpoint, count(*) AS requests, sum(f)::BIGINT AS failures, round(1 - sum(f) / count(*), 6) AS success_rate, round(avg(value), 6) AS avg_latency, min(value) AS min_latency, max(value) AS max_latency FROM r GROUP BY endpoint""",
)
def metrics_by_endpoint(spark, d):
    e = _table(spark, d, "events")
    return figures(e, "value", F.col("event_type") == "error", endpoint(F.concat(F.lit("/api/"), "event_type", F.lit("/"), F.col("user_id").cast("string"))).alias("endpoint"))
