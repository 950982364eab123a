"""Layered proximity graph as an edge table.

A node's level is the number of trailing zero bits of its sequence number (at most 9): geometric with ratio
1/2, and the same on every run. On each level a node links to the m nearest earlier nodes of that level, both
ways. Building is a triangular nearest-neighbour join per level; searching moves a beam down the
levels, one join with the edges each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import GraphConfig
from ..functions.metrics import pair_distance
from ..shared import stage
from ..workers import map_arrow
from .knn import DECIMALS, knn_join, measured, prepared, top_k

TOP_LEVEL = 9
#: Size of a graph that is sent to every worker: four bytes a link, and its vectors.
LOCAL_BYTES = 512 << 20


def nodes(data: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, vec, level); the id is the sequence number."""
    n = F.col("id").cast("bigint") + 1
    return prepared(data, id_col, vector_col).withColumn("level", F.least(F.lit(TOP_LEVEL), F.bit_count(n.bitwiseAND(-n) - 1)).cast("int"))


def edges(graph: DataFrame, config: GraphConfig, levels: int = TOP_LEVEL + 1) -> DataFrame:
    """(level, src, dst), symmetric and distinct."""
    per_level = {r["level"]: r["n"] for r in graph.groupBy("level").agg(F.count("*").alias("n")).collect()}
    parts = []
    for level in range(levels):
        rows = sum(n for at, n in per_level.items() if at >= level)
        if not rows and parts:
            break
        own = graph.where(F.col("level") >= level).select("id", F.col("vec").alias("vector"))
        near = knn_join(own, own, config.m, config.metric, rule="earlier", sizes=(rows, rows)).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
        both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
        # the later node is always first in ``near``, so no edge comes twice
        parts.append(near.select(both.alias("e")).select(F.lit(level).alias("level"), "e.src", "e.dst"))
    return reduce(DataFrame.unionByName, parts)


class _Local:
    """The whole graph in a worker, for one that is small by its counted size: the same walk, without a join a level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]):
        """``links``: for each level, where the neighbours of each node start, and the neighbours; nodes by their place among ``ids``, which ascend."""
        self.ids, self.vectors, self.links = ids, vectors, links
        self.entry = int(np.lexsort((ids, -levels))[0])
        self.top = int(levels.max())

    def _beside(self, level: int, rows: np.ndarray) -> np.ndarray:
        starts, dst = self.links[level]
        parts = [dst[starts[r] : starts[r + 1]] for r in rows]
        return np.unique(np.concatenate(parts)) if parts else rows

    def search(self, q: np.ndarray, config: GraphConfig, k: int, hops: int) -> tuple[np.ndarray, np.ndarray]:
        exact = pair_distance(config.metric)

        def ranked(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
            d = np.round(exact(np.broadcast_to(q, (len(rows), len(q))), self.vectors[rows].astype(np.float64, copy=False)), DECIMALS) + 0.0
            order = np.lexsort((rows, d))[:most]
            return rows[order], d[order]

        beam = np.array([self.entry])
        for level in range(self.top, 0, -1):
            reached = self._beside(level, beam)
            beam, _ = ranked(reached if len(reached) else beam, config.ef_search)
        for _ in range(hops):
            beam = np.union1d(beam, self._beside(0, beam))
        return ranked(beam, k)


def _beside_by_level(links: DataFrame, level: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A level's links as (starts, neighbours), of which the driver gets one list a node."""
    own = links.where(F.col("level") == level).groupBy("src").agg(F.collect_list("dst").alias("dst")).toArrow()
    at = np.searchsorted(ids, np.asarray(own["src"], np.int64))
    sizes = np.asarray(pc.list_value_length(own["dst"]), np.int64)
    dst = np.concatenate([np.searchsorted(ids, np.asarray(c.flatten(), np.int64)).astype(np.int32) for c in own["dst"].chunks] or [np.zeros(0, np.int32)])
    src = np.repeat(at, sizes)
    order = np.lexsort((dst, src))
    return np.searchsorted(src[order], np.arange(len(ids) + 1)).astype(np.int32), dst[order]


def _search_local(queries: DataFrame, graph: DataFrame, links: DataFrame, config: GraphConfig, k: int, hops: int) -> DataFrame:
    rows = graph.select("id", "vec", "level").toArrow().sort_by("id")
    ids, levels = np.asarray(rows["id"], np.int64), np.asarray(rows["level"], np.int64)
    vectors = np.concatenate([np.asarray(c.flatten(), np.float64) for c in rows["vec"].chunks]).reshape(len(ids), -1)
    short = vectors.astype(np.float32)
    vectors = short if np.array_equal(short.astype(np.float64), vectors) else vectors  # half the size where nothing is lost
    beside = [_beside_by_level(links, level, ids) for level in range(int(levels.max()) + 1)]
    own = _Local(ids, vectors, levels, beside)
    shared = queries.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            found = [g.search(np.asarray(v.values, np.float64), config, k, hops) for v in b.column(1)]
            size = np.fromiter((len(r) for r, _ in found), np.int64, len(found))
            cat = lambda i, kind: np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind)
            rank = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(rank.astype(np.int32)), pa.array(g.ids[cat(0, np.int64)]), pa.array(cat(1, np.float64))], ["query_id", "rank", "id", "distance"])

    spread = queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(spread, run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, id bigint, distance double")


def graph_search(queries: DataFrame, graph: DataFrame, links: DataFrame, config: GraphConfig, k: int, hops: int = 1, id_col: str = "id", vector_col: str = "vector", local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """(query_id, rank, id, distance) by beam search.

    Enters at the smallest id of the highest level that has nodes. Above level 0 the beam becomes the ``ef_search`` nearest
    neighbours of its members, or stays if there are none; at level 0 the members and their neighbours of
    ``hops`` rounds are ranked. ``graph`` and ``links`` should be written tables. A graph of up to ``local_bytes``, by the counted
    nodes and edges, is sent to the workers, which walk it for each query; a larger one is walked by a join a level. The result is the same.
    """
    q = prepared(queries, id_col, vector_col).select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    entry = graph.orderBy(F.desc("level"), "id").limit(1).select("id", "level", F.size("vec").alias("dims")).first()
    if entry is None:
        return q.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("id"), F.lit(0.0).alias("distance")).limit(0)
    if graph.count() * (8 * entry["dims"] + 60) + links.count() * 4 <= local_bytes:
        return _search_local(q, graph, links, config, k, hops)
    vectors = graph.select("id", "vec")
    beam = q.select("query_id", F.lit(entry["id"]).alias("id"))
    by_distance = Window.partitionBy("query_id").orderBy("distance", "id")
    for level in range(entry["level"], 0, -1):
        own = links.where(F.col("level") == level).select(F.col("src").alias("id"), "dst")
        stepped = beam.join(own, "id", "left").groupBy("query_id").agg(F.collect_set("dst").alias("next"), F.collect_set("id").alias("same"))
        reached = stepped.select("query_id", F.explode(F.when(F.size("next") > 0, F.col("next")).otherwise(F.col("same"))).alias("id"))
        ranked = measured(reached.join(vectors, "id").join(q, "query_id"), config.metric)
        kept = ranked.withColumn("r", F.row_number().over(by_distance)).where(F.col("r") <= config.ef_search).select("query_id", "id")
        beam = stage(kept, f"beam-{level}")  # else each level would plan, and run, all those above it again
    own = links.where(F.col("level") == 0).select(F.col("src").alias("id"), "dst")
    for _ in range(hops):
        beam = beam.unionByName(beam.join(own, "id").select("query_id", F.col("dst").alias("id"))).distinct()
    ranked = measured(beam.join(vectors, "id").join(q, "query_id"), config.metric)
    return top_k(ranked, k).select("query_id", "rank", "id", "distance")


def graph_stats(graph: DataFrame, links: DataFrame) -> DataFrame:
    """(level, nodes, edges) of every level that has nodes."""
    spread = graph.select(F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level")).groupBy("level").agg(F.count("*").alias("nodes"))
    return spread.join(links.groupBy("level").agg(F.count("*").alias("edges")), "level", "left").select("level", "nodes", F.coalesce("edges", F.lit(0)).cast("bigint").alias("edges"))
