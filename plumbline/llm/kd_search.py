"""Exact top-k search with one KD-tree per shard.

Vectors are sharded by the upper levels of a KD-tree, so regions are compact and have tight bounding boxes; a region of
more than ``shard_rows`` rows (a dense spot, equal vectors, or more rows than the planes' sample can tell apart) is
dealt out to several shards by a hash of the id. A query first searches the shard it lies in; the distance of its kth neighbour there is
then propagated: the query goes on only to regions whose box is no farther than that, found by a walk down the upper tree, and carries the bound
with it. Within a shard, nearby queries walk the tree together, best box first, and each drops
out of a subtree whose box is beyond its own kth distance.

The split planes come from a sample (``sample`` rows; they shape the regions and change no result), so there are at most
``sample`` / 8 regions, and what is sent to every worker (planes and boxes of regions) has a bound. Shards
hold about ``shard_rows`` rows each and arriving queries are cut into parts of as many, so
that a task's memory is bounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import narrow, stage, table

K, SHARD_ROWS, LEAF, SAMPLE = 10, 16_384, 128, 20_000
#: The registered query searches for every row whose id is divisible by this, among all rows.
EVERY = 20
#: Distances are compared, and given, to this many decimals; ties go by id.
DECIMALS = 6
_SLACK = 2 * 10.0**-DECIMALS


class KdTree:
    """Median splits of the widest side; every node has the tight box of its points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.middle = points.mean(0) if len(points) else np.zeros(points.shape[1])
        self.nodes: list[tuple] = []  # (low, high, rows or None, children or None)
        self.root = self._build(np.arange(len(points))) if len(points) else -1

    def _build(self, rows: np.ndarray) -> int:
        p = self.points[rows]
        low, high = p.min(0), p.max(0)
        if len(rows) <= self.leaf:
            self.nodes.append((low, high, rows, None))
        else:
            order = rows[np.argpartition(p[:, (high - low).argmax()], len(rows) // 2)]
            kids = self._build(order[: len(rows) // 2]), self._build(order[len(rows) // 2 :])
            self.nodes.append((low, high, None, kids))
        return len(self.nodes) - 1

    def leaves(self) -> list[np.ndarray]:
        return [n[2] for n in self.nodes if n[2] is not None]


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance of each query to the box."""
    out = np.maximum(np.maximum(low - q, q - high), 0)
    return np.sqrt(np.einsum("ij,ij->i", out, out))


def search_tree(tree: KdTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point id, distance) of each query's k nearest points of another id, by (rounded distance, id).

    ``bound``: what lies beyond it isn't wanted. All queries walk together. Products of vectors decide what is measured
    difference by difference: they are taken around the tree's middle, and allowed their rounding error, which grows with the norms."""
    n = len(queries)
    dist, who = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
    kth = bound.copy()
    around = queries - tree.middle
    norm = np.einsum("ij,ij->i", around, around)
    heap = [(0.0, 0, tree.root)] if tree.root >= 0 and n else []
    number = 1
    gaps: dict[int, np.ndarray] = {0: box_distance(queries, *tree.nodes[tree.root][:2])} if heap else {}
    while heap:
        least, tag, at = heapq.heappop(heap)
        gap = gaps.pop(tag)
        if least > kth.max() + _SLACK:
            break
        live = np.flatnonzero(gap <= kth + _SLACK)
        if not len(live):
            continue
        _, _, rows, kids = tree.nodes[at]
        if kids:
            for kid in kids:
                gap = np.full(n, np.inf)
                gap[live] = box_distance(queries[live], *tree.nodes[kid][:2])
                gaps[number] = gap
                heapq.heappush(heap, (float(gap.min()), number, kid))
                number += 1
            continue
        p = tree.points[rows]
        c = p - tree.middle
        both = norm[live, None] + np.einsum("ij,ij->i", c, c)[None, :]
        near = both - 2 * (around[live] @ c.T)
        reach = (kth[live, None] + _SLACK) ** 2 + 8 * (p.shape[1] + 2) * np.finfo(np.float64).eps * both
        a, b = np.nonzero((near <= reach) & (ids[rows][None, :] != query_ids[live, None]))
        if not len(a):
            continue
        diff = queries[live[a]] - p[b]
        d = np.round(np.sqrt(np.einsum("ij,ij->i", diff, diff)), DECIMALS)
        _merge(dist, who, live[a], d, ids[rows[b]], k)
        kth[live] = np.minimum(bound[live], dist[live, k - 1])
    row, col = np.nonzero(np.isfinite(dist))
    return row, who[row, col], dist[row, col]


def _merge(dist: np.ndarray, who: np.ndarray, row: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Put (row, d, ids) into the rows' sorted k best."""
    touched, at = np.unique(row, return_inverse=True)
    r = np.concatenate([at, np.repeat(np.arange(len(touched)), k)])
    d = np.concatenate([d, dist[touched].ravel()])
    i = np.concatenate([ids, who[touched].ravel()])
    order = np.lexsort((i, d, r))
    r, d, i = r[order], d[order], i[order]
    first = np.searchsorted(r, np.arange(len(touched)))
    keep = np.arange(len(r)) - first[r] < k
    dist[touched], who[touched] = d[keep].reshape(-1, k), i[keep].reshape(-1, k)


def _vectors(col: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = col.flatten() if isinstance(col, pa.ListArray) else pa.concat_arrays([c.flatten() for c in col.chunks if len(c)] or [pa.array([], pa.float64())])
    return np.asarray(flat, np.float64).reshape(-1, dims)


def _walk(points_t: pa.Table, queries_t: pa.Table, dims: int, k: int, leaf: int) -> pa.Table:
    ids, points = np.asarray(points_t["vec_id"], np.int64), _vectors(points_t["vec"], dims)
    q_ids, q, bound = np.asarray(queries_t["vec_id"], np.int64), _vectors(queries_t["vec"], dims), np.asarray(queries_t["kth"], np.float64)
    tree = KdTree(points, leaf)
    groups = KdTree(q, leaf).leaves()
    out = [(q_ids[g[r]], i, d) for g in groups for r, i, d in [search_tree(tree, ids, q[g], q_ids[g], bound[g], k)]]
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"vec_id": cols[0], "neighbour": cols[1], "distance": cols[2]})


def _planes(sample: np.ndarray, regions: int) -> list | int:
    """Upper KD-tree over a sample: [dim, cut, left, right] or a region's number."""
    numbers = iter(range(regions))

    def split(p: np.ndarray, count: int):
        if count == 1 or len(p) < 2:
            return next(numbers)
        side = int((p.max(0) - p.min(0)).argmax())
        left = count // 2
        order = np.argsort(p[:, side], kind="stable")
        cut = len(p) * left // count
        return [side, float(p[order[cut], side]), split(p[order[:cut]], left), split(p[order[cut:]], count - left)]

    return split(sample, regions)


def _place(planes, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    stack = [(planes, np.arange(len(points)))]
    while stack:
        node, rows = stack.pop()
        if not isinstance(node, list):
            out[rows] = node
            continue
        right = points[rows, node[0]] >= node[1]
        stack += [(node[2], rows[~right]), (node[3], rows[right])]
    return out


def _placed(planes, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(planes, _vectors(b.column(1), dims))), *b.columns], ["region", "vec_id", "vec"])

    return run


def _boxed(planes, boxes: dict[int, tuple[np.ndarray, np.ndarray]]):
    """The upper tree with the boxes of its nodes: (low, high, children or None, region), or None where there are no rows."""
    if not isinstance(planes, list):
        return (*boxes[planes], None, planes) if planes in boxes else None
    kids = [k for k in (_boxed(planes[2], boxes), _boxed(planes[3], boxes)) if k]
    return (np.min([k[0] for k in kids], 0), np.max([k[1] for k in kids], 0), kids, -1) if kids else None


def _routed(upper, lone: frozenset[int], dims: int):
    """A row for each region that a query goes on to; its own is one only if other shards are in it (it isn't in ``lone``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, q, kth = np.asarray(b.column(0)), _vectors(b.column(3), dims), np.asarray(b.column(4), np.float64)
            stack = [(upper, np.arange(len(q)))]
            while stack:
                (low, high, kids, region), rows = stack.pop()
                rows = rows[box_distance(q[rows], low, high) <= kth[rows] + _SLACK]
                if kids:
                    stack += [(k, rows) for k in kids if len(rows)]
                    continue
                if region in lone:
                    rows = rows[home[rows] != region]
                if len(rows):
                    part = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), region, np.int32)), *part.columns], ["region", "home", "own", "vec_id", "vec", "kth"])

    return run


def _found(k: int, dims: int, leaf: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        return _walk(points, queries, dims, k, leaf)

    return run


def top_k(
    vectors: DataFrame,
    k: int = K,
    shard_rows: int = SHARD_ROWS,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    every: int = 1,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, rank, neighbour, distance): the k rows nearest (Euclidean) to each row whose id is divisible by ``every``, itself left out.

    Distances have six decimals and ties go by the smaller id. Rows with a null id, and vectors that are null, empty or hold
    nulls or numbers that aren't finite, take no part; vectors meet others of their length only. Of rows that
    repeat an id the least vector counts. Equal vectors are at distance 0. Fewer than k others give fewer ranks; an empty table gives none.
    Other columns play no part.
    """
    if k < 1 or every < 1:
        raise ValueError("k and every must be at least 1")
    own = narrow(vectors, vec_id=id_col, vec=vector_col).where("vec_id is not null and size(vec) > 0")
    own = own.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"))
    own = own.where(F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)))
    own = stage(own, "vectors")
    repeated = own.groupBy("vec_id").count().where("count > 1")
    if not repeated.isEmpty():
        own = stage(own.groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors-once")
    parts = [_top_k(own.where(F.size("vec") == r["dims"]), r["dims"], r["n"], k, shard_rows, leaf, sample, every) for r in own.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).collect()]
    if not parts:
        return own.select("vec_id", F.lit(0).alias("rank"), F.col("vec_id").alias("neighbour"), F.lit(0.0).alias("distance")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns, which Spark can tell from those of the table that they come from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _top_k(own: DataFrame, dims: int, rows: int, k: int, shard_rows: int, leaf: int, sample: int, every: int) -> DataFrame:
    spark = own.sparkSession
    regions = max(1, min(-(-rows // shard_rows), sample // 8))
    planes: list | int = 0
    if regions > 1:
        planes = _planes(_vectors(own.orderBy(F.xxhash64("vec_id")).limit(sample).select("vec").toArrow()["vec"], dims), regions)
    placed = stage(own.mapInArrow(_placed(planes, dims), "region int, vec_id bigint, vec array<double>"), "regions")
    # at most ``regions`` rows
    sides = [F.array(*[f(F.col("vec")[i]) for i in range(dims)]).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    known = placed.groupBy("region").agg(F.count("*").alias("n"), *sides).collect()
    boxes = {r["region"]: (np.array(r["low"]), np.array(r["high"])) for r in known}
    shards = {r["region"]: -(-r["n"] // shard_rows) for r in known}
    counted = F.broadcast(spark.createDataFrame([(int(r), int(n)) for r, n in shards.items()], "region int, shards int"))
    points = placed.join(counted, "region").select("region", F.pmod(F.xxhash64("vec_id", F.lit(1)), "shards").cast("int").alias("shard"), "vec_id", "vec", "shards")
    asked = _renewed(points.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("kth", F.lit(float("inf"))))
    found, result = _found(k, dims, leaf), "vec_id bigint, neighbour bigint, distance double"
    first = stage(points.groupBy("region", "shard").cogroup(asked.groupBy("region", "shard")).applyInArrow(found, result), "home")
    best = Window.partitionBy("vec_id").orderBy("distance", "neighbour")
    if sum(shards.values()) > 1:
        bounds = first.groupBy("vec_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("kth"))
        bounded = asked.drop("kth").join(bounds, "vec_id", "left").select(F.col("region").alias("home"), F.col("shard").alias("own"), "vec_id", "vec", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
        lone = frozenset(r for r, n in shards.items() if n == 1)
        arriving = stage(bounded.mapInArrow(_routed(_boxed(planes, boxes), lone, dims), "region int, home int, own int, vec_id bigint, vec array<double>, kth double"), "arriving")
        cuts = F.broadcast(arriving.groupBy("region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("cuts")))
        spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        q = arriving.join(cuts, "region").join(counted, "region").withColumn("shard", spread("shards")).where("region <> home or shard <> own")
        q = _renewed(q.select("region", "shard", F.pmod(F.xxhash64("vec_id"), "cuts").cast("int").alias("cut"), "vec_id", "vec", "kth"))
        p = points.join(cuts, "region").select("region", "shard", spread("cuts").alias("cut"), "vec_id", "vec")
        by = ["region", "shard", "cut"]
        first = first.unionByName(p.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(found, result))
    return first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=EVERY)


SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_distance(a.e, b.e), {DECIMALS}) + 0.0 AS distance
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour)::INT AS rank FROM pairs)
SELECT vec_id, rank, neighbour, distance FROM ranked WHERE rank <= {K}
"""
