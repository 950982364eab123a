"""The forest against its definition: a best-first walk by a queue, and nodes split row by row."""

import heapq

import numpy as np
import pytest

from plumbline.config import ForestConfig
from plumbline.operators import forest

CONFIG, DIMS = ForestConfig(num_trees=3, max_leaf_size=4), 6


def rows(n=400):
    x = np.random.default_rng(8).normal(0, 1, (n, DIMS)).round(2)
    x[9] = 0
    return x


def split(x, tree, path, own):
    right = x[own] @ forest.hyperplane(CONFIG.seed, tree, path, DIMS) >= 0
    if len(own) <= CONFIG.max_leaf_size or right.all() or not right.any():
        return {path: own.tolist()}
    return split(x, tree, path + "0", own[~right]) | split(x, tree, path + "1", own[right])


def walk(skeleton, v, visits):
    inner = [{leaf[:n] for leaf in own for n in range(len(leaf))} for own in skeleton]
    heap, found = [(0.0, t, "") for t in range(len(skeleton))], set()
    while heap and len(found) < visits:
        _, t, path = heapq.heappop(heap)
        if path in skeleton[t]:
            found.add((t, path))
        elif path in inner[t]:
            margin = float(v @ forest.hyperplane(CONFIG.seed, t, path, DIMS))
            near, far = ("1", "0") if margin >= 0 else ("0", "1")
            heapq.heappush(heap, (0.0, t, path + near))
            heapq.heappush(heap, (abs(margin), t, path + far))
    return found


@pytest.mark.parametrize("visits", [1, 3, 10, 47, 120])
def test_visited_leaves_are_those_of_the_walk(visits):
    x = rows()
    leaves = [sorted(split(x, t, "", np.arange(len(x)))) for t in range(CONFIG.num_trees)]
    skeleton = forest._Skeleton(leaves, CONFIG, DIMS)
    bits = np.unpackbits(skeleton.visited(x[:150], visits), axis=1, bitorder="little")
    names = [(t, path) for t, own in enumerate(leaves) for path in own]
    for i in range(150):
        assert {names[n] for n in np.flatnonzero(bits[i])} == walk([set(own) for own in leaves], x[i], visits)
    assert skeleton.visited(x[:2], len(names)) is None


@pytest.mark.parametrize("most", [forest.NODE_ROWS, 50, 0])
def test_leaves_are_the_same_wherever_a_node_is_split(spark, monkeypatch, most):
    monkeypatch.setattr(forest, "NODE_ROWS", most)
    x = rows(120)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").coalesce(2)
    got = {(r["tree"], r["path"], r["id"]) for r in forest.leaves(df, CONFIG, DIMS).collect()}
    want = {(t, path, i) for t in range(CONFIG.num_trees) for path, own in split(x, t, "", np.arange(len(x))).items() for i in own}
    assert got == want


def test_search_does_not_copy_rows_for_each_visit(spark):
    x = rows()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()
    placed = forest.leaves(df, CONFIG, DIMS).cache()
    found = forest.forest_search(df, df, placed, CONFIG, DIMS, 3)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    assert found.count() == 3 * len(x)
