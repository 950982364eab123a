"""Exact k-nearest-neighbour joins.

Both sides are packed into blocks of vectors. The blocks meet in a Cartesian product. A block of queries keeps its k best
while the blocks of a share of the data come by, and only points that can still come in are measured; the k best of each share are all that leaves it, and a window over these few rows
picks the final k. All pairs are looked at, but each costs little more than its part of a matrix product; what is
shuffled grows with the rows (k for a query and share of ``SHARE`` blocks).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ValidationError
from ..functions.metrics import block_distance, distance, metric_name, pair_distance
from ..shared import broadcast_if_small, stage
from ..workers import importable, map_arrow
from .nearest import DECIMALS, Nearest

#: Vectors in a block at most, and blocks of the data that a task meets.
BLOCK, SHARE = 4096, 64
#: Queries in a block at least, where there are few; tasks for a core.
_LEAST, _TASKS = 64, 4
_SPARE = 4


def prepared(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) as doubles; rows without an id or a vector are left out."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        label = (context.partitionId() if context else 0) << 32
        held: dict[int, list] = {}

        def row(parts: list) -> pa.RecordBatch:
            nonlocal label
            label += 1
            ids, vecs = pa.concat_arrays([p[0] for p in parts]), pa.concat_arrays([p[1].flatten() for p in parts])
            columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, vecs)]
            return pa.RecordBatch.from_arrays([pa.array([label]), *columns], ["block", "ids", "flat"])

        for b in batches:
            sizes = np.asarray(pc.list_value_length(b.column(1)))
            for dims in np.unique(sizes):
                own = b.filter(pa.array(sizes == dims)) if len(np.unique(sizes)) > 1 else b
                parts, at = held.setdefault(int(dims), []), 0
                while at < own.num_rows:
                    part = own.slice(at, size - sum(len(p[0]) for p in parts))
                    parts.append((part.column(0), part.column(1)))
                    at += part.num_rows
                    if sum(len(p[0]) for p in parts) == size:
                        yield row(parts)
                        parts.clear()
        for parts in held.values():
            if parts:
                yield row(parts)

    return run


def pack(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks (block, ids, flat) of an (id, vec) table, of ``size`` vectors; vectors of different lengths are in different blocks."""
    kind = vectors.schema["id"].dataType.simpleString()
    return map_arrow(vectors, _packed(size), f"block bigint, ids array<{kind}>, flat array<double>")


def crossed(q: DataFrame, p: DataFrame, sizes: tuple[int, int] | None = None, most: int = BLOCK, share: int = SHARE) -> DataFrame:
    """(block, ids, flat, p_block, p_ids, p_flat): all blocks of two (id, vec) tables, which have ``sizes`` rows. Each is packed once, and dealt out
    so that every core has blocks of queries to do, of ``most`` rows, and a task holds ``share`` blocks of the data at most."""
    n_q, n_p = sizes or (q.count(), p.count())
    cores = q.sparkSession.sparkContext.defaultParallelism

    def dealt(df: DataFrame, rows: int, size: int, parts: int) -> DataFrame:
        # partitions of a few rows each would give as many blocks
        return pack(df.coalesce(max(cores, -(-rows // (4 * size)))), size).repartition(parts)

    size = min(most, max(_LEAST, -(-n_q // (_TASKS * cores))))
    blocks = max(1, -(-n_q // size))
    left = dealt(q, n_q, size, min(blocks, max(_TASKS * cores, -(-blocks // share))))
    right = dealt(p, n_p, BLOCK, max(1, -(-n_p // (BLOCK * share))))
    # else a small side would be broadcast, and the other one's partitions be the tasks
    return left.hint("shuffle_replicate_nl").crossJoin(right.withColumnsRenamed({"block": "p_block", "ids": "p_ids", "flat": "p_flat"}))


def _nearest(q: np.ndarray, p: np.ndarray, qi: np.ndarray, pi: np.ndarray, k: int, block, exact, rule: str = "all") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, distance) of the k nearest points of each query, and a few spare ones; points are in id order."""
    d = np.round(block(q, p), DECIMALS)
    if rule == "others":
        d[qi[:, None] == pi[None, :]] = np.inf
    elif rule == "earlier":
        d[qi[:, None] <= pi[None, :]] = np.inf
    n = min(len(p), k + _SPARE)
    if n < len(p):
        # the spare ones make up for the block form's rounding; ties within are settled by position
        cut = np.partition(d, n - 1, axis=1)[:, n - 1]
        rank = np.cumsum(d == cut[:, None], axis=1)
        room = n - (d < cut[:, None]).sum(1)
        keep = (d < cut[:, None]) | ((d == cut[:, None]) & (rank <= room[:, None]))
    else:
        keep = np.ones(d.shape, bool)
    r, c = np.nonzero(keep & (d < np.inf))
    return r, c, np.round(exact(q[r], p[c]), DECIMALS) + 0.0


def keys_of(ids: pa.Array) -> np.ndarray:
    return np.array(ids.to_pylist()) if not pa.types.is_integer(ids.type) else np.asarray(ids)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, Iterator[tuple[pa.Array, np.ndarray]]]]:
    """(query ids, queries, the (ids, points) that they meet) of ``crossed`` rows, which come by block of queries; each is to be read to its end."""
    rows = ([b.column(c)[i] for c in range(6)] for b in batches for i in range(b.num_rows))
    matrix = lambda ids, flat: np.asarray(flat.values, np.float64).reshape(len(ids.values), -1)
    for _, own in groupby(rows, key=lambda r: r[0].as_py()):
        first = next(own)
        yield first[1].values, matrix(first[1], first[2]), ((r[4].values, matrix(r[4], r[5])) for r in chain([first], own))


def _meet(metric: str, k: int, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q, met in meetings(batches):
            nearest, seen, at = Nearest(q, keys_of(q_ids), k, metric, rule), [], 0
            for p_ids, p in met:
                if q.shape[1] != p.shape[1]:
                    raise ValidationError(f"vectors of length {q.shape[1]} and {p.shape[1]}")
                nearest.add(p, keys_of(p_ids), at)
                seen.append(p_ids)
                at += len(p_ids)
            row, place, d = nearest.result()
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), pa.concat_arrays(seen).take(pa.array(place)), pa.array(d)], ["query_id", "id", "distance"])

    return run


def marked_join(queries: DataFrame, data: DataFrame, marks: tuple[int, int], admits, k: int, metric: str) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of the rows that count for a query, by the exact join.

    Both sides are (id, vec), where ``vec`` is a vector and then the row's ``marks`` whole numbers. ``admits(query marks, point marks)`` gives
    a function of (query rows, point rows) that tells which pairs count, and the query rows that come into question, or None for all of them.
    For groups that take in so much of the data that their rows had better not travel once a group.
    """
    a, b = marks
    metric = metric_name(metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q, met in meetings(batches):
            own, q = q[:, -a:].astype(np.int64), np.ascontiguousarray(q[:, :-a])
            nearest, seen, at = Nearest(q, keys_of(q_ids), k, metric), [], 0
            for p_ids, p in met:
                if q.shape[1] != p.shape[1] - b:
                    raise ValidationError(f"vectors of length {q.shape[1]} and {p.shape[1] - b}")
                allowed, rows = admits(own, p[:, -b:].astype(np.int64))
                nearest.add(np.ascontiguousarray(p[:, :-b]), keys_of(p_ids), at, allowed, rows)
                seen.append(p_ids)
                at += len(p_ids)
            row, place, d = nearest.result()
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), pa.concat_arrays(seen).take(pa.array(place)), pa.array(d)], ["query_id", "id", "distance"])

    types = [x.schema["id"].dataType.simpleString() for x in (queries, data)]
    found = map_arrow(crossed(queries, data), run, f"query_id {types[0]}, id {types[1]}, distance double")
    return top_k(found, k).select("query_id", "rank", "id", "distance")


def lists_of(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))


#: Rows of a group, on either side, that meet in one product; rows of the data in a task, about.
GROUP_ROWS, TASK_ROWS = 4096, 50_000


def _dealt(df: DataFrame, id_col: str, other: str) -> DataFrame:
    """``df`` with the part of its group that each row is in, and how many parts the group has. Groups of over ``GROUP_ROWS`` rows,
    of which there are few, are counted first."""
    large = df.groupBy("group").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias(other)).where(F.col(other) > 1)
    large = stage(large, "large-groups")
    if large.isEmpty():
        return df.withColumn(other, F.lit(1)).withColumn(f"{other}_part", F.lit(0))
    joined = df.join(broadcast_if_small(large), "group", "left").withColumn(other, F.coalesce(other, F.lit(1)))
    return joined.withColumn(f"{other}_part", F.pmod(F.xxhash64(id_col), other).cast("int"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    sizes = pc.unique(pc.list_value_length(column))
    if len(sizes) > 1 or len(sizes) and sizes[0].as_py() != dims:
        raise ValidationError("vectors of different lengths")
    return np.concatenate([np.asarray(c.flatten(), np.float64) for c in column.chunks]).reshape(len(column), dims)


def _in_groups(metric: str, k: int):
    block, exact = block_distance(metric), pair_distance(metric)
    names = ["query_id", "id", "distance"]

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        kinds = queries.schema.field("query_id").type, data.schema.field("id").type
        if not queries.num_rows or not data.num_rows:
            return pa.table([pa.array([], t) for t in (*kinds, pa.float64())], names)
        dims = len(data["vec"][0])
        q, p = _matrix(queries["q"], dims), _matrix(data["vec"], dims)
        q_ids, p_ids = queries["query_id"].combine_chunks(), data["id"].combine_chunks()
        q_rank, p_rank = (np.unique(np.array(x.to_pylist()), return_inverse=True)[1] for x in (q_ids, p_ids))
        q_cell, p_cell = np.asarray(queries["cell"], np.int64), np.asarray(data["cell"], np.int64)
        q_order, p_order = np.argsort(q_cell, kind="stable"), np.lexsort((p_rank, p_cell))
        cells = np.intersect1d(q_cell, p_cell)
        sides = [np.searchsorted(own[order], cells, side) for own, order in ((q_cell, q_order), (p_cell, p_order)) for side in ("left", "right")]
        rows, points, distances = [], [], []
        for a, b, c, e in zip(*sides):
            qs, ps = q_order[a:b], p_order[c:e]
            for at in range(0, len(qs), 1024):
                own = qs[at : at + 1024]
                r, i, d = _nearest(q[own], p[ps], own, ps, k, block, exact)
                rows.append(own[r]), points.append(ps[i]), distances.append(d)
        row, point, d = (np.concatenate(x) for x in (rows, points, distances)) if rows else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        # a pair may meet in several groups; k different ones a query leave the task
        who = q_rank[row]
        order = np.lexsort((p_rank[point], d, who))
        row, point, d, who = row[order], point[order], d[order], who[order]
        new = np.ones(len(row), bool)
        new[1:] = (who[1:] != who[:-1]) | (p_rank[point[1:]] != p_rank[point[:-1]])
        row, point, d, who = row[new], point[new], d[new], who[new]
        first = np.searchsorted(who, who)
        kept = np.arange(len(who)) - first < k
        return pa.table([q_ids.take(pa.array(row[kept])), p_ids.take(pa.array(point[kept])), pa.array(d[kept])], names)

    return run


def group_search(queries: DataFrame, data: DataFrame, by: list[str], k: int, metric: str) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of each query among those that share a group with it.

    ``queries``: (by, query_id, q), ``data``: (by, id, vec); a row may be in several groups. Each row travels once a group it is in, and a group is one
    matrix product, of which k rows a query leave the task; groups of over ``GROUP_ROWS`` rows on either side meet in parts.
    """
    group = F.xxhash64(*by).alias("group")
    q, p = stage(queries.select(group, "query_id", "q"), "asked"), stage(data.select(group, "id", "vec"), "listed")
    tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-p.count() // TASK_ROWS))
    dealt_q, dealt_p = _dealt(q, "query_id", "qs"), _dealt(p, "id", "ps")
    many_q, many_p = (x.select("group", n).distinct().where(F.col(n) > 1) for x, n in ((dealt_q, "qs"), (dealt_p, "ps")))
    # each part of one side goes to every part of the other
    full_q = dealt_q.join(many_p, "group", "left").withColumn("ps_part", F.explode(F.sequence(F.lit(0), F.coalesce("ps", F.lit(1)) - 1)))
    full_p = dealt_p.join(many_q, "group", "left").withColumn("qs_part", F.explode(F.sequence(F.lit(0), F.coalesce("qs", F.lit(1)) - 1)))
    cell = F.xxhash64("group", "qs_part", "ps_part")
    left = full_q.select(F.pmod(cell, F.lit(tasks)).alias("task"), cell.alias("cell"), "query_id", "q")
    right = full_p.select(F.pmod(cell, F.lit(tasks)).alias("task"), cell.alias("cell"), "id", "vec")
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((q, "query_id"), (p, "id"))]
    importable(q.sparkSession)
    found = left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(_in_groups(metric_name(metric), k), f"query_id {kinds[0]}, id {kinds[1]}, distance double")
    once = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return top_k(once, k).select("query_id", "rank", "id", "distance")


def measured(pairs: DataFrame, metric: str) -> DataFrame:
    """(query_id, id, distance) of (query_id, id, q, vec) candidate pairs, in Arrow batches: several times as fast as
    higher-order functions, which are not compiled."""
    measure = pair_distance(metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = b.column(2), b.column(3)
            if not pc.all(pc.equal(pc.list_value_length(x), pc.list_value_length(y))).as_py():
                raise ValidationError("vectors of different lengths")
            sizes = np.asarray(pc.list_value_length(x))
            x, y = np.asarray(x.flatten(), np.float64), np.asarray(y.flatten(), np.float64)
            if len(np.unique(sizes)) == 1:
                d = measure(x.reshape(len(sizes), -1), y.reshape(len(sizes), -1))
            else:
                cuts = np.cumsum(sizes)[:-1]
                d = np.array([measure(p[None], q[None])[0] for p, q in zip(np.split(x, cuts), np.split(y, cuts))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(d, DECIMALS) + 0.0)], ["query_id", "id", "distance"])

    own = pairs.select("query_id", "id", "q", "vec")
    kinds = [own.schema[c].dataType.simpleString() for c in ("query_id", "id")]
    return map_arrow(own, run, f"query_id {kinds[0]}, id {kinds[1]}, distance double")


def top_k(pairs: DataFrame, k: int, key: str = "query_id", id_col: str = "id") -> DataFrame:
    """The k nearest rows of each key with their rank; Spark cuts each partition before the shuffle."""
    best = Window.partitionBy(key).orderBy("distance", id_col)
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def knn_join(
    queries: DataFrame,
    data: DataFrame,
    k: int,
    metric: str = "cosine",
    query_id: str = "id",
    query_vector: str = "vector",
    id_col: str = "id",
    vector_col: str = "vector",
    rule: str = "all",
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of ``data`` for every row of ``queries``.

    Distances have six decimals; ties go by the smaller id. ``rule``: "all", "others" (not the row of the query's own
    id) or "earlier" (smaller ids only). ``sizes``: the numbers of rows, where they are known. Rows without an id or vector take no part; unequal lengths raise.
    An empty side gives an empty result.
    """
    if k < 1:
        raise ValidationError("k must be at least 1")
    if rule not in ("all", "others", "earlier"):
        raise ValidationError(f"unknown rule: {rule}")
    q, p = prepared(queries, query_id, query_vector), prepared(data, id_col, vector_col)
    q_type, p_type = (x.schema["id"].dataType.simpleString() for x in (q, p))
    found = map_arrow(crossed(q, p, sizes), _meet(metric_name(metric), k, rule), f"query_id {q_type}, id {p_type}, distance double")
    return top_k(found, k).select("query_id", "rank", "id", "distance")


def search(data: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(rank, id, distance) for a single query vector: JVM expressions and a top-k sort, no Python."""
    if query is None or k < 1:
        raise ValidationError("a query vector and k >= 1 are needed")
    p = prepared(data, id_col, vector_col)
    d = F.round(distance(metric, p["vec"], F.array(*[F.lit(float(x)) for x in query])), DECIMALS)
    nearest = p.select("id", d.alias("distance")).orderBy("distance", "id").limit(k)
    return nearest.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id"))).select("rank", "id", "distance")


def similarity_matrix(left: DataFrame, right: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(a, b, similarity): cosine similarities of all pairs, block by block; a zero vector gives 0."""
    a, b = prepared(left, id_col, vector_col), prepared(right, id_col, vector_col)
    types = [x.schema["id"].dataType.simpleString() for x in (a, b)]
    block = block_distance("cosine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x_ids, x, y_ids, y = (batch.column(c)[i].values for c in (1, 2, 4, 5))
                x, y = np.asarray(x).reshape(len(x_ids), -1), np.asarray(y).reshape(len(y_ids), -1)
                if x.shape[1] != y.shape[1]:
                    raise ValidationError(f"vectors of length {x.shape[1]} and {y.shape[1]}")
                for at in range(0, len(x), 256):
                    part = block(x[at : at + 256], y)
                    r, c = np.indices(part.shape).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([x_ids.take(pa.array(r + at)), y_ids.take(pa.array(c)), pa.array(np.round(1.0 - part.ravel(), DECIMALS) + 0.0)], ["a", "b", "similarity"])

    return map_arrow(crossed(a, b), run, f"a {types[0]}, b {types[1]}, similarity double")


def anomalies(data: DataFrame, threshold: float, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, distance): rows whose nearest other row is farther than ``threshold``."""
    nearest = knn_join(data, data, 1, metric, id_col, vector_col, id_col, vector_col, "others")
    return nearest.where(F.col("distance") > threshold).select(F.col("query_id").alias("id"), "distance")
