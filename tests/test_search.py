"""Metrics and searches against plain NumPy."""

import numpy as np
import pytest

from plumbline.config import ForestConfig, GraphConfig, IvfConfig, LshConfig, index_config
from plumbline.errors import ConfigurationError, QuantizationError, ValidationError
from plumbline.functions import metrics
from plumbline.operators import clusters, forest, graph, knn, lsh, quantize
from pyspark.sql import functions as F

DIMS = 6


def reference(metric, a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    pos = lambda x: x > 0
    if metric == "cosine":
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return 1 - (0.0 if n == 0 else float(np.clip(a @ b / n, -1, 1)))
    if metric == "jaccard":
        either = (pos(a) | pos(b)).sum()
        return 1 - (1.0 if either == 0 else (pos(a) & pos(b)).sum() / either)
    return {"euclidean": np.linalg.norm(a - b), "dot_product": -(a @ b), "manhattan": np.abs(a - b).sum(), "chebyshev": np.abs(a - b).max(), "hamming": (pos(a) != pos(b)).sum()}[metric]


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(42).normal(0, 3, (150, DIMS)).round(3)
    x[3], x[7] = 0, x[8]  # a zero vector and a tie
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()


def nearest(metric, x, q, k, allowed=None):
    rows = [(round(float(reference(metric, q, x[i])), 6) + 0.0, i) for i in (range(len(x)) if allowed is None else allowed)]
    return [(i, d) for d, i in sorted(rows)[:k]]


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    return out


@pytest.mark.parametrize("metric", metrics.METRICS)
def test_join_is_exact_on_unnormalised_vectors(cloud, metric):
    x, df = cloud
    found = by_query(knn.knn_join(df, df, 4, metric))
    for i in range(len(x)):
        want = nearest(metric, x, x[i], 4)
        assert [j for j, _ in found[i]] == [j for j, _ in want]
        assert np.allclose([d for _, d in found[i]], [d for _, d in want], atol=2e-6)


@pytest.mark.parametrize("metric", metrics.METRICS)
def test_columns_agree_with_numpy(spark, cloud, metric):
    x, df = cloud
    q = x[5]
    rows = df.select("id", metrics.distance(metric, F.col("vector"), F.array(*[F.lit(float(v)) for v in q])).alias("d")).collect()
    assert all(abs(r["d"] - reference(metric, x[r["id"]], q)) < 1e-9 for r in rows)
    pairs = metrics.pair_distance(metric)(x, np.repeat(q[None], len(x), 0))
    assert np.allclose(pairs, [reference(metric, v, q) for v in x])


def test_small_and_odd_cases(spark, cloud):
    x, df = cloud
    empty = df.limit(0)
    assert knn.knn_join(df, empty, 3).count() == knn.knn_join(empty, df, 3).count() == 0
    assert knn.knn_join(df.where("id < 3"), df.where("id < 2"), 5).count() == 6  # k above the number of rows
    odd = spark.createDataFrame([(None, [1.0] * DIMS), (1, None), (2, []), (3, [1.0] * DIMS)], "id long, vector array<double>")
    assert [r["id"] for r in knn.knn_join(odd, odd, 3).collect()] == [3]
    with pytest.raises(ValidationError):
        knn.knn_join(df, df, 0)
    with pytest.raises(ValidationError):
        metrics.metric_name("nope")
    found, want = knn.search(df, x[9].tolist(), 3).orderBy("rank").collect(), nearest("cosine", x, x[9], 3)
    assert [r["id"] for r in found] == [i for i, _ in want] and np.allclose([r["distance"] for r in found], [d for _, d in want], atol=1e-6)
    with pytest.raises(Exception, match="length"):
        knn.knn_join(df, spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"), 1).collect()


def test_other_rules_and_string_ids(spark, cloud):
    x, df = cloud
    named = df.select(F.format_string("n%03d", "id").alias("id"), "vector")
    found = by_query(knn.knn_join(named, named, 2, rule="others"))
    assert all(q not in [i for i, _ in hits] for q, hits in found.items())
    earlier = by_query(knn.knn_join(df, df, 2, "euclidean", rule="earlier"))
    assert 0 not in earlier and all(i < q for q, hits in earlier.items() for i, _ in hits)
    assert {r["id"] for r in knn.anomalies(df, 1e9).collect()} == set()


def test_normalisation(spark):
    df = spark.createDataFrame([([3.0, -4.0],), ([0.0, 0.0],)], "v array<double>")
    get = lambda kind: [r[0] for r in df.select(metrics.normalize(F.col("v"), kind)).collect()]
    assert get("l2") == [[0.6, -0.8], [0.0, 0.0]] and get("max")[0] == [0.75, -1.0]
    assert np.allclose(get("l1")[0], [3 / 7, -4 / 7])
    assert metrics.register_sql(spark) and spark.sql("select vec_euclidean(array(0D, 3D), array(4D, 0D))").first()[0] == 5.0


def test_inverted_lists(cloud):
    x, df = cloud
    config = IvfConfig(num_clusters=8, num_probes=8, metric="euclidean")
    centres = clusters.train(df, config)
    lists = clusters.assign(df, centres, "euclidean")
    placed = {r["id"]: r["cluster_id"] for r in lists.collect()}
    assert all(placed[i] == np.round(np.linalg.norm(np.array(centres) - v, axis=1), 6).argmin() for i, v in enumerate(x))
    every = by_query(clusters.ivf_search(df, lists, centres, 3, 8, "euclidean"))
    assert all([i for i, _ in every[q]] == [i for i, _ in nearest("euclidean", x, x[q], 3)] for q in range(len(x)))
    hits = [sum(len({i for i, _ in h} & {i for i, _ in every[q]}) for q, h in by_query(clusters.ivf_search(df, lists, centres, 3, p, "euclidean")).items()) for p in (1, 3)]
    assert hits[0] <= hits[1]
    assert clusters.cluster_stats(lists).first()["vectors"] == len(x)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_hashing(cloud, metric):
    x, df = cloud
    config = LshConfig(metric=metric, num_tables=3, num_bits=4)
    planes, offsets = lsh.projections(config, DIMS)
    code = {}
    for r in lsh.buckets(df, config, DIMS).collect():
        dots = np.array(planes[r["table_no"]]) @ x[r["id"]]
        bits = np.floor((dots + offsets[r["table_no"]]) / 4.0).astype(int) % 2 if metric == "euclidean" else (dots >= 0).astype(int)
        assert r["bucket"] == int("".join(map(str, bits)), 2)
        code.setdefault(r["id"], set()).add((r["table_no"], r["bucket"]))
    found = by_query(lsh.lsh_search(df, df, config, DIMS, 3))
    for q in range(len(x)):
        assert [i for i, _ in found[q]] == [i for i, _ in nearest(metric, x, x[q], 3, [i for i in code if code[i] & code[q]])]


def test_graph(cloud):
    x, df = cloud
    config = GraphConfig(m=4, ef_search=20)
    g = graph.nodes(df)
    links = graph.edges(g, config)
    level = {r["id"]: r["level"] for r in g.collect()}
    assert all(level[i] == min(9, ((i + 1) & -(i + 1)).bit_length() - 1) for i in level)
    edges = {(r["level"], r["src"], r["dst"]) for r in links.collect()}
    assert all((lv, b, a) in edges for lv, a, b in edges)
    for i in (5, 63, 100):
        want = {j for j, _ in nearest("cosine", x, x[i], 4, [j for j in range(i)])}
        assert {b for lv, a, b in edges if lv == 0 and a == i and b < i} >= want
    found = by_query(graph.graph_search(df, g, links, config, 5))
    few = df.where("id < 12")
    assert by_query(graph.graph_search(few, g, links, config, 5, local_bytes=0)) == {q: found[q] for q in range(12)}  # the join a level gives the same
    exact = {q: {i for i, _ in nearest("cosine", x, x[q], 5)} for q in range(len(x))}
    assert sum(len({i for i, _ in found[q]} & exact[q]) for q in exact) > 0.8 * 5 * len(x)


def test_forest(cloud):
    x, df = cloud
    config = ForestConfig(num_trees=4, max_leaf_size=8)
    placed = forest.leaves(df, config, DIMS, 10)
    rows = placed.collect()
    assert len(rows) == 4 * len(x)
    by_leaf = {}
    for r in rows:
        by_leaf.setdefault((r["tree"], r["path"]), []).append(r["id"])
        for d, bit in enumerate(r["path"]):
            side = x[r["id"]] @ forest.hyperplane(config.seed, r["tree"], r["path"][:d], DIMS) >= 0
            assert bit == "01"[int(side)]
    for (tree, path), own in by_leaf.items():
        if len(own) > 8 and len(path) < 10:  # only where the next plane has all rows on one side
            sides = x[own] @ forest.hyperplane(config.seed, tree, path, DIMS) >= 0
            assert sides.all() or not sides.any()
    everything = ForestConfig(num_trees=4, max_leaf_size=8, search_k=10_000)
    found = by_query(forest.forest_search(df, df, placed, everything, DIMS, 3))
    assert all([i for i, _ in found[q]] == [i for i, _ in nearest("cosine", x, x[q], 3)] for q in range(len(x)))


def test_quantizers(cloud):
    x, df = cloud
    for bits in (8, 16):
        q = quantize.ScalarQuantizer.train(df, DIMS, bits)
        back = np.array([r[0] for r in df.orderBy("id").select(q.decode(q.encode(F.col("vector")))).collect()])
        assert np.abs(back - x).max() <= max(q.scale) / 2 + 1e-9
    p = quantize.ProductQuantizer.train(df, DIMS, 3, 16, 10)
    codes = df.select("id", p.encode(F.col("vector")).alias("codes"))
    books = np.array(p.codebooks)
    for r in codes.collect():
        d = ((x[r["id"]].reshape(3, 1, 2) - books) ** 2).sum(2)
        assert np.allclose(d[range(3), r["codes"]], d.min(1))
    code = {r["id"]: r["codes"] for r in codes.collect()}
    for q, hits in by_query(p.search(df, codes, 4)).items():
        full = sorted((round(float(np.linalg.norm(x[q] - np.concatenate([books[m][c] for m, c in enumerate(code[i])]))), 6), i) for i in code)
        assert [i for i, _ in hits] == [i for _, i in full[:4]]
    with pytest.raises(QuantizationError):
        quantize.ProductQuantizer.train(df, DIMS, 4)


def test_settings():
    assert index_config("fast").m == 8 and index_config("IVF", num_clusters=5, num_probes=2).kind == "ivf"
    for bad in (dict(kind="hnsw", m=1), dict(kind="ivf", num_clusters=2, num_probes=3), dict(kind="lsh", num_bits=33), dict(kind="annoy", search_k=0), dict(kind="none"), dict(kind="flat", x=1)):
        with pytest.raises((ConfigurationError, ValidationError)):
            index_config(**bad)


def recall(spark, name, sf="sf0.001"):
    from plumbline.plans import catalogue

    d = f"/root/testdata/{sf}"
    return catalogue._recall(catalogue.QUERIES[name](spark, d), catalogue.QUERIES["knn_cosine"](spark, d)).first()["recall"]


def test_multiprobe_recall(spark):
    assert recall(spark, "lsh_search_multiprobe") >= 0.9


def test_wide_inverted_lists_recall(spark):
    assert recall(spark, "ivf_search_wide") >= 0.9


def test_quantized_recall(spark):
    from plumbline.plans import catalogue

    d = "/root/testdata/sf0.001"
    assert catalogue._recall(catalogue.QUERIES["pq_search_reranked"](spark, d), catalogue.QUERIES["knn_euclidean"](spark, d)).first()["recall"] >= 0.9


def test_forest_recall(spark):
    assert recall(spark, "annoy_search", "sf0.1") >= 0.9
