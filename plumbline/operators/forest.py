"""Random-projection forest: leaves as rows, and a best-first walk over the trees' skeletons.

A node's hyperplane is a function of (seed, tree, path), so every row can follow its path down all trees on its own.
Which prefix of that path is its leaf depends only on node sizes, which one aggregation gives.
"""

from __future__ import annotations

import heapq
import math
import os
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ForestConfig
from ..errors import IndexError_
from ..shared import broadcast_if_small, stage
from ..workers import importable, map_arrow
from .knn import crossed, keys_of, meetings, prepared, top_k
from .nearest import Nearest

#: Levels that a round of the build goes down, as long as a node has more rows than a task takes.
STEP, NODE_ROWS = 6, 65_536
#: Skeleton nodes that are sent to the workers; a larger forest is cut at the depth where it fits.
SKELETON = 1_000_000
#: Queries whose leaves are found together, numbers that this holds, and blocks of the data that a task meets.
_QUERIES, _HELD, _SHARE = 1024, 1 << 21, 256
#: Of all leaves, those that a query visits: a fixed number of them would find less the larger the table is.
SHARE = 0.12


def hyperplane(seed: int, tree: int, path: str, dims: int) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}/{tree}/{path}"))
    v = rng.standard_normal(dims)
    return (v / np.linalg.norm(v)).round(6)


def _paths(config: ForestConfig, dims: int, depth: int):
    """(tree, full, id): the paths of rows (id, vec, paths), of which a null one is at its end, followed down to ``depth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, dims)
            known = np.array(b.column(2).to_pylist(), object).reshape(len(x), config.num_trees)
            for tree in range(config.num_trees):
                at = {}
                for row, path in enumerate(known[:, tree]):
                    if path is not None:
                        at.setdefault(path, []).append(row)
                rows, full = [], []
                todo = [(path, np.array(own)) for path, own in at.items()]
                while todo:
                    path, own = todo.pop()
                    if len(path) == depth:
                        rows.append(own), full.extend([path] * len(own))
                        continue
                    right = x[own] @ hyperplane(config.seed, tree, path, dims) >= 0
                    todo += [(path + bit, part) for bit, part in (("0", own[~right]), ("1", own[right])) if len(part)]
                rows = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), tree, np.int32)), pa.array(full, pa.string()), b.column(0).take(rows)], ["tree", "full", "id"])

    return run


def _below(config: ForestConfig, dims: int, depth: int | None):
    """(tree, path, id): the leaves of the rows (tree, full, id, vec) of one node."""

    def run(node: pa.Table) -> pa.Table:
        x = np.concatenate([np.asarray(c.flatten(), np.float64) for c in node["vec"].chunks]).reshape(-1, dims)
        tree, todo, rows, paths = node["tree"][0].as_py(), [(node["full"][0].as_py(), np.arange(len(x)))], [], []
        while todo:
            path, own = todo.pop()
            if len(own) > config.max_leaf_size and len(path) != depth:
                right = x[own] @ hyperplane(config.seed, tree, path, dims) >= 0
                if right.any() and not right.all():
                    todo += [(path + "0", own[~right]), (path + "1", own[right])]
                    continue
            rows.append(own), paths.append(path)
        path = pa.array(paths, pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows])))
        return pa.table([pa.array(np.full(len(x), tree, np.int32)), path, node["id"].combine_chunks().take(pa.array(np.concatenate(rows)))], ["tree", "path", "id"])

    return run


def leaves(data: DataFrame, config: ForestConfig, dims: int, depth: int | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(tree, path, id): the leaf of every row in every tree.

    A node is a leaf if it has at most ``max_leaf_size`` rows, if all of them are on one side of its plane, or at ``depth``, if that is given.
    While a node has over ``NODE_ROWS`` rows, ``STEP`` levels are gone down at a time, by the rows whose leaf isn't found yet. A smaller node is one task's, down to its leaves.
    """
    own = prepared(data, id_col, vector_col)
    kind = own.schema["id"].dataType.simpleString()
    state = own.withColumn("paths", F.array_repeat(F.lit(""), config.num_trees))
    found, base = [], 0
    rest = own.select(F.explode(F.sequence(F.lit(0), F.lit(config.num_trees - 1))).alias("tree"), F.lit("").alias("full"), "id")
    largest = own.count()
    while True:
        if largest <= NODE_ROWS:
            importable(own.sparkSession)
            nodes = rest.join(own, "id") if base else own.select(F.explode(F.sequence(F.lit(0), F.lit(config.num_trees - 1))).alias("tree"), F.lit("").alias("full"), "id", "vec")
            last = nodes.select("tree", "full", "id", "vec").groupBy("tree", "full").applyInArrow(_below(config, dims, depth), f"tree int, path string, id {kind}")
            return reduce(DataFrame.unionByName, [*found, last])
        to = base + STEP if depth is None else min(depth, base + STEP)
        full = stage(map_arrow(state.select("id", "vec", "paths"), _paths(config, dims, to), f"tree int, full string, id {kind}"), "paths")
        prefixes = F.transform(F.sequence(F.lit(base), F.lit(to)), lambda n: F.substring(F.col("full"), F.lit(1), n))
        sizes = full.select("tree", F.explode(prefixes).alias("path")).groupBy("tree", "path").agg(F.count("*").alias("n"))
        # a child as large as its parent has an empty brother
        parents = sizes.select("tree", F.col("n").alias("child_n"), F.substring("path", F.lit(1), F.length("path") - 1).alias("path"), F.length("path").alias("l")).where(F.col("l") > base)
        lone = sizes.join(parents.groupBy("tree", "path").agg(F.max("child_n").alias("larger")), ["tree", "path"], "left")
        ends = (F.col("n") <= config.max_leaf_size) | F.coalesce(F.col("larger") == F.col("n"), F.lit(False))
        if to == depth:
            ends = ends | (F.length("path") == to)
        steps = full.select("tree", "id", "full", F.explode(prefixes).alias("path")).join(lone.where(ends).select("tree", "path"), ["tree", "path"])
        done = stage(steps.groupBy("tree", "id").agg(F.min_by("path", F.length("path")).alias("path")).select("tree", "path", "id"), "leaves")
        found.append(done)
        rest = stage(full.join(done, ["tree", "id"], "left_anti"), "deeper")
        if to == depth or rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        largest = rest.groupBy("tree", "full").count().agg(F.max("count")).first()[0]
        open_paths = rest.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tree", "full"))).alias("m"))
        paths = F.transform(F.sequence(F.lit(0), F.lit(config.num_trees - 1)), lambda t: F.try_element_at("m", t))
        state, base = own.join(open_paths, "id").withColumn("paths", paths), to


def tree_stats(placed: DataFrame) -> DataFrame:
    """(tree, leaves, nodes, max_depth, vectors): a binary tree has one node fewer inside than it has leaves."""
    own = placed.groupBy("tree", "path").agg(F.count("*").alias("n"))
    return own.groupBy("tree").agg(
        F.count("*").alias("leaves"), (2 * F.count("*") - 1).alias("nodes"), F.max(F.length("path")).alias("max_depth"), F.sum("n").alias("vectors")
    )


class _Skeleton:
    """The trees as arrays, level by level: the planes of a level are one product with the queries."""

    def __init__(self, leaves: list[list[str]], config: ForestConfig, dims: int):
        self.paths = leaves
        self.starts = np.cumsum([0, *map(len, leaves)])
        self.number = [{path: n for n, path in enumerate(own, start)} for own, start in zip(leaves, self.starts.tolist())]
        self.trees, self.plane = [], [{} for _ in leaves]
        for tree, number in enumerate(self.number):
            inner = {path[:n] for path in number for n in range(len(path))}
            nodes, levels = [""], []
            while nodes:
                ends = [(i, number[p]) for i, p in enumerate(nodes) if p in number]
                splits = [i for i, p in enumerate(nodes) if p in inner]
                planes = np.array([hyperplane(config.seed, tree, nodes[i], dims) for i in splits]).reshape(-1, dims)
                # six decimals are a whole number of millionths: half the size, and back without a loss
                planes = np.rint(planes * 1e6).astype(np.int32)
                self.plane[tree].update((nodes[i], plane) for i, plane in zip(splits, planes))
                levels.append((planes, np.array(splits, np.int64), *np.array(ends, np.int64).reshape(-1, 2).T))
                nodes = [nodes[i] + bit for i in splits for bit in "01"]
            self.trees.append(levels)

    def _keys(self, q: np.ndarray) -> np.ndarray:
        """(query, leaf): the largest margin that is crossed on the way to a leaf."""
        keys, sides = np.empty((self.starts[-1], len(q))), np.ascontiguousarray(q.T)
        for levels in self.trees:
            key = np.zeros((1, len(q)))
            for planes, splits, ends, numbers in levels:
                keys[numbers] = key[ends]
                held, key = key[splits], np.empty((2 * len(splits), len(q)))
                margin = (planes / 1e6) @ sides
                np.maximum(held, margin, out=key[0::2])
                np.maximum(held, np.negative(margin, out=margin), out=key[1::2])
        return np.ascontiguousarray(keys.T)

    def visited(self, q: np.ndarray, visits: int) -> np.ndarray | None:
        """(query, leaf / 8) as bits: the ``visits`` leaves that a walk by a priority queue reaches first; None if these are all.

        The walk takes the nearest plane that is left, so all leaves of a key below the last one's are visited. Those of that very key lie below one plane,
        and there the walk is made.
        """
        count = int(self.starts[-1])
        if visits >= count:
            return None
        bits, step = np.zeros((len(q), -(-count // 8)), np.uint8), max(16, min(128, _HELD // count))
        for at in range(0, len(q), step):
            keys = self._keys(q[at : at + step])
            some = np.sort(keys[:, :: max(1, count // 4096)], axis=1)
            guess = some[:, min(some.shape[1] - 1, int(some.shape[1] * (visits / count + 0.03)))]
            for i, key in enumerate(keys):
                near = key[key <= guess[i]]
                near = near if len(near) >= visits else key
                last = np.partition(near, visits - 1)[visits - 1]
                inside = key < last
                left, ties = visits - int(np.count_nonzero(inside)), np.flatnonzero(key == last)
                if len(ties) > left:
                    whole = self._walk(q[at + i], visits, left, last, ties)
                    ties, inside = whole if isinstance(whole, tuple) else (whole, inside)
                inside[ties] = True
                bits[at + i] = np.packbits(inside, bitorder="little")
        return bits

    def _walk(self, v: np.ndarray, visits: int, left: int, last: float, ties: np.ndarray):
        trees = np.unique(np.searchsorted(self.starts, ties, "right") - 1)
        if len(trees) > 1 or last == 0:  # planes of equal margins: the walk of all trees
            none = np.zeros(int(self.starts[-1]), bool)
            return np.array(self._first([(0.0, t, "") for t in range(len(self.paths))], v, visits, np.inf)), none
        tree = int(trees[0])
        top = os.path.commonprefix([self.paths[tree][n - self.starts[tree]] for n in (int(ties.min()), int(ties.max()))])
        return np.array(self._first([(0.0, tree, top)], v, left, last))

    def _first(self, heap: list[tuple[float, int, str]], v: np.ndarray, visits: int, limit: float) -> list[int]:
        heapq.heapify(heap)
        found = []
        while heap and len(found) < visits:
            _, t, path = heapq.heappop(heap)
            if path in self.number[t]:
                found.append(self.number[t][path])
                continue
            if path not in self.plane[t]:
                continue
            margin = float(v @ (self.plane[t][path] / 1e6))
            near = "1" if margin >= 0 else "0"
            heapq.heappush(heap, (0.0, t, path + near))
            if abs(margin) < limit:
                heapq.heappush(heap, (abs(margin), t, path + ("0" if near == "1" else "1")))
        return found


#: The skeleton of this worker's last search: its tasks share it.
_LAST: dict[str, _Skeleton] = {}


def _search(shared, trees: int, config: ForestConfig, dims: int, visits: int, k: int):
    label = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q, met in meetings(batches):
            if label not in _LAST:
                _LAST.clear()
                _LAST[label] = _Skeleton(shared.value, config, dims)
            bits = _LAST[label].visited(q, visits)
            nearest, seen, at = Nearest(q, keys_of(q_ids), k, config.metric), [], 0
            for p_ids, p in met:
                p, own = np.ascontiguousarray(p[:, :-trees]), p[:, -trees:].astype(np.int64)

                def allowed(rows: np.ndarray, points: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                    open_ = np.arange(len(rows))
                    for t in range(trees):
                        n = own[points[open_], t]
                        open_ = open_[(bits[rows[open_], n >> 3] >> (n & 7).astype(np.uint8)) & 1 == 0]
                    out = np.ones(len(rows), bool)
                    out[open_] = False
                    return out

                nearest.add(p, keys_of(p_ids), at, None if bits is None else allowed)
                seen.append(p_ids)
                at += len(p_ids)
            row, place, d = nearest.result()
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), pa.concat_arrays(seen).take(pa.array(place)), pa.array(d)], ["query_id", "id", "distance"])

    return run


def forest_search(queries: DataFrame, data: DataFrame, placed: DataFrame, config: ForestConfig, dims: int, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, id, distance) among the rows of the leaves visited first.

    At most ``search_k`` leaves (by default trees x leaf size, or ``SHARE`` of all leaves if that is more) are visited,
    nearest margin first; inner nodes and empty ones don't count. ``placed`` should be
    a written table. A skeleton of over ``SKELETON`` leaves is cut to the depth at which it fits: leaves below
    then count as one, which only adds candidates.

    A share of all leaves has most rows among them, so the rows are not brought together leaf by leaf: it is the exact join, in which a pair counts if the query visits a leaf of the row.
    """
    per_depth = {r["d"]: r["n"] for r in placed.select(F.length("path").alias("d"), "tree", "path").distinct().groupBy("d").agg(F.count("*").alias("n")).collect()}
    if not per_depth:
        raise IndexError_("the forest has no rows")
    depth, total = 0, 0
    for d in sorted(per_depth):
        total += per_depth[d]
        if total > SKELETON and d > 0:
            break
        depth = d
    cut = placed.withColumn("leaf", F.substring("path", F.lit(1), F.lit(depth)))
    skeleton: list[list[str]] = [[] for _ in range(config.num_trees)]
    nodes = cut.select("tree", "leaf").distinct().toArrow().sort_by([("tree", "ascending"), ("leaf", "ascending")])
    for tree, leaf in zip(nodes["tree"].to_pylist(), nodes["leaf"].to_pylist()):
        skeleton[tree].append(leaf)
    visits = max(config.num_trees * config.max_leaf_size, math.ceil(SHARE * sum(map(len, skeleton)))) if config.search_k == -1 else config.search_k
    spark = placed.sparkSession
    numbers = stage(spark.createDataFrame(nodes.append_column("n", pa.array(np.arange(len(nodes), dtype=np.int64)))), "leaf-numbers")
    own = cut.join(broadcast_if_small(numbers), ["tree", "leaf"]).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("tree", "n"))).alias("t"))
    marks = own.select("id", F.transform("t", lambda x: x["n"].cast("double")).alias("leaf"))
    p = prepared(data, id_col, vector_col).join(marks, "id").select("id", F.concat("vec", "leaf").alias("vec"))
    q = prepared(queries, id_col, vector_col)
    types = [x.schema["id"].dataType.simpleString() for x in (q, p)]
    run = _search(spark.sparkContext.broadcast(skeleton), config.num_trees, config, dims, visits, k)
    found = map_arrow(crossed(q, p, most=_QUERIES, share=_SHARE), run, f"query_id {types[0]}, id {types[1]}, distance double")
    return top_k(found, k).select("query_id", "rank", "id", "distance")
