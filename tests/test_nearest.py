"""The kernels of the exact join: results of brute force, and few pairs measured."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import metrics
from plumbline.operators import knn, quantize
from plumbline.operators.nearest import Nearest


def brute(q, q_keys, p, keys, k, metric, rule):
    out, exact = [], metrics.pair_distance(metric)
    for i in range(len(q)):
        d = np.round(exact(np.repeat(q[i : i + 1], len(p), 0), p), 6) + 0.0
        ok = {"all": np.ones(len(p), bool), "others": keys != q_keys[i], "earlier": keys < q_keys[i]}[rule]
        own = np.flatnonzero(ok)
        out += [(i, j, d[j]) for j in own[np.lexsort((keys[own], d[own]))][:k]]
    return out


@pytest.mark.parametrize("rule", ["all", "others", "earlier"])
@pytest.mark.parametrize("metric", metrics.METRICS)
def test_kernels_equal_brute_force(metric, rule):
    rng = np.random.default_rng(1)
    for dims, whole in ((6, True), (64, False)):
        x = rng.normal(0, 3 if whole else 0.125, (1200, dims))
        x = x.round(0) if whole else x
        x[5], x[7], x[100:400] = 0, x[8], x[100]  # a zero vector, a tie, and many copies
        keys, own = rng.permutation(len(x)), np.arange(0, len(x), 29)
        for names in (keys, np.array([f"n{i:04d}" for i in keys])):
            near = Nearest(x[own], names[own], 10, metric, rule)
            for at in range(0, len(x), 350):
                near.add(x[at : at + 350], names[at : at + 350], at)
            got, want = list(zip(*near.result())), brute(x[own], names[own], x, names, 10, metric, rule)
            assert [g[:2] for g in got] == [w[:2] for w in want]
            assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)


@pytest.mark.parametrize("metric", metrics.METRICS)
def test_few_pairs_are_measured(metric):
    x = np.random.default_rng(2).normal(0, 1, (20_000, 64))
    near = Nearest(x[:100], np.arange(100), 10, metric)
    measured, exact = [], near.exact
    near.exact = lambda a, b: measured.append(len(a)) or exact(a, b)
    for at in range(0, len(x), 4096):
        near.add(x[at : at + 4096], np.arange(at, min(len(x), at + 4096)), at)
    assert len(near.result()[0]) == 1000 and sum(measured) < 0.02 * 100 * len(x)


def test_blocks_are_dealt_out_and_leave_k_rows(spark):
    df = spark.range(9000).select("id", F.array(F.rand(1), F.rand(2), F.rand(3)).alias("vec")).coalesce(1)
    met = knn.crossed(df, df)
    assert met.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    own = met.select(F.size("ids").alias("n"), F.size("p_ids").alias("m"))
    assert own.agg(F.sum(F.col("n") * F.col("m"))).first()[0] == 9000**2
    found = knn.map_arrow(met, knn._meet("euclidean", 3, "all"), "query_id bigint, id bigint, distance double")
    assert found.count() == 3 * 9000  # not 3 for every block of the data


def test_quantized_join_does_not_carry_vectors_a_candidate(spark):
    x = np.random.default_rng(3).normal(0, 1, (400, 8)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    p = quantize.ProductQuantizer(np.random.default_rng(4).normal(0, 1, (4, 8, 2)).round(3).tolist())
    codes = {r["id"]: r["codes"] for r in p.encoded(df).collect()}
    back = np.array([p._words(np.array([codes[i]]))[0] for i in range(len(x))])
    reranked = p.search_reranked(df, df, p.encoded(df), 3, spare=5)
    found = {}
    for r in reranked.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    for i, v in enumerate(x):
        near = np.lexsort((np.arange(len(x)), np.round(np.linalg.norm(back - v, axis=1), 6)))[:15]
        assert found[i] == near[np.lexsort((near, np.round(np.linalg.norm(x[near] - v, axis=1), 6)))][:3].tolist()
    plan = reranked._jdf.queryExecution().toString()
    assert plan.count("CartesianProduct") == 1 and plan.split("== Physical Plan ==")[1].count("SortMergeJoin") + plan.split("== Physical Plan ==")[1].count("BroadcastHashJoin") <= 1


def test_a_step_of_k_means_is_a_product_for_each_part():
    import pyarrow as pa

    from plumbline.operators import clusters

    x = np.random.default_rng(5).normal(3, 1, (5000, 8))
    centres, cuts = [x[:40, :4].copy(), x[40:80, 4:].copy()], [(0, 4), (4, 8)]
    centres[0][7] = centres[0][3]  # of two equal centres the first counts
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array((np.arange(5001) * 8).astype(np.int32)), pa.array(x.ravel()))], ["vec"])
    rows = next(clusters._step(centres, cuts, "euclidean")([batch])).to_pylist()
    got = {(r["part"], r["k"]): (r["n"], r["total"]) for r in rows}
    assert (0, 7) not in got
    for m, (a, e) in enumerate(cuts):
        near = ((x[:, None, a:e] - centres[m][None]) ** 2).sum(2).argmin(1)
        for k in set(near.tolist()):
            own = x[near == k, a:e]
            assert got[m, k][0] == len(own) and np.allclose(got[m, k][1], own.sum(0))
    assert clusters._closest(centres[0], "euclidean")(x[:, :4]).shape == (5000,)


def test_wide_searches_do_not_copy_rows_for_each_group(spark, monkeypatch):
    from plumbline.config import LshConfig
    from plumbline.operators import clusters, lsh

    x = np.random.default_rng(6).normal(0, 1, (700, 6)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()
    config, centres = LshConfig(num_tables=2, num_bits=5), x[:7].tolist()
    searches = [lambda: lsh.lsh_search(df, df, config, 6, 3, flips=2), lambda: clusters.ivf_search(df, clusters.assign(df, centres), centres, 3, 4)]
    wide = [s() for s in searches]
    assert all("FlatMapCoGroups" not in w._jdf.queryExecution().toString() for w in wide)
    monkeypatch.setattr(clusters, "WIDE", 1e9)
    monkeypatch.setattr(lsh, "WIDE", 1e9)
    for w, s in zip(wide, searches):
        assert sorted(w.collect()) == sorted(s().collect())


def test_recall_reads_the_exact_search_once(spark):
    from plumbline.plans import catalogue

    plan = catalogue.QUERIES["recall_at_10_lsh"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CartesianProduct") == 1


def test_a_link_of_a_local_graph_is_four_bytes(spark):
    from plumbline.config import GraphConfig
    from plumbline.operators import graph

    x = np.random.default_rng(7).normal(0, 1, (200, 4)).round(3)
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()
    config = GraphConfig(m=4, ef_search=20)
    g = graph.nodes(df).cache()
    links = graph.edges(g, config).cache()
    size = g.count() * (8 * 4 + 60) + links.count() * 4
    few = df.where("id < 30")
    near, far = (graph.graph_search(few, g, links, config, 5, local_bytes=size - n) for n in (0, 1))
    assert "Window" not in near._jdf.queryExecution().toString() and "Window" in far._jdf.queryExecution().toString()
    assert sorted(near.collect()) == sorted(far.collect())
