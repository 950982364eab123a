"""Locality-sensitive hashing: buckets as rows, search as an equi-join on (table, bucket)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LshConfig
from ..errors import IndexError_, ValidationError
from ..workers import map_arrow
from .clusters import WIDE
from .knn import group_search, lists_of, marked_join, prepared


def projections(config: LshConfig, dims: int) -> tuple[list[list[list[float]]], list[list[float]]]:
    """Seeded Gaussian directions [table][bit][dim], of unit length unless the metric is Euclidean, and offsets [table][bit]."""
    rng = np.random.default_rng(config.seed)
    p = rng.standard_normal((config.num_tables, config.num_bits, dims))
    if config.metric != "euclidean":
        p /= np.linalg.norm(p, axis=2, keepdims=True)
    return p.round(6).tolist(), rng.uniform(0, config.bucket_width, (config.num_tables, config.num_bits)).round(6).tolist()


def _codes(config: LshConfig, dims: int, keep_vector: bool):
    """The bucket of every vector in every table: bits packed, the first one highest."""
    p, offsets = (np.array(x) for x in projections(config, dims))
    weights = 1 << np.arange(config.num_bits - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            if b.num_rows and x.shape[1] != dims:
                raise ValidationError(f"vectors of length {x.shape[1]} and {dims}")
            for t in range(config.num_tables):
                dots = x.reshape(-1, dims) @ p[t].T
                bits = np.floor((dots + offsets[t]) / config.bucket_width).astype(np.int64) % 2 if config.metric == "euclidean" else (dots >= 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), t, np.int32)), pa.array(bits @ weights), *b.columns[: 1 + keep_vector]], ["table_no", "bucket", "id", "vec"][: 3 + keep_vector])

    return run


def buckets(data: DataFrame, config: LshConfig, dims: int, id_col: str = "id", vector_col: str = "vector", keep_vector: bool = False) -> DataFrame:
    """(table_no, bucket, id) of every row in every table; a map over the rows, without a shuffle."""
    own = prepared(data, id_col, vector_col)
    schema = f"table_no int, bucket bigint, id {own.schema['id'].dataType.simpleString()}" + ", vec array<double>" * keep_vector
    return map_arrow(own, _codes(config, dims, keep_vector), schema)


def _marked(config: LshConfig, dims: int):
    """(id, vec): vectors and then their buckets, table by table."""
    codes = _codes(config, dims, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1 if b.num_rows else dims)
            yield pa.RecordBatch.from_arrays([b.column(0), lists_of(np.column_stack([x, *(np.asarray(t.column(1), np.float64) for t in codes([b]))]))], ["id", "vec"])

    return run


def _within(flips: int):
    def admits(asked: np.ndarray, placed: np.ndarray):
        def allowed(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
            near = np.zeros(len(rows), bool)
            for t in range(asked.shape[1]):
                near |= np.bitwise_count(asked[rows, t] ^ placed[points, t]) <= flips
            return near

        return allowed, None

    return admits


def lsh_search(queries: DataFrame, data: DataFrame, config: LshConfig, dims: int, k: int, id_col: str = "id", vector_col: str = "vector", flips: int = 0) -> DataFrame:
    """(query_id, rank, id, distance) among rows that share a bucket with the query in any table,
    or whose bucket's number differs from the query's in at most ``flips`` bits.

    Each bucket is one matrix product for its rows and the queries that look into it. Where a query looks into ``WIDE`` of all buckets or more,
    the exact join measures the pairs whose buckets are so near.
    """
    if dims < 1:
        raise IndexError_("the dimension is not known")
    looks = sum(comb(config.num_bits, n) for n in range(flips + 1))
    if looks * config.num_tables >= WIDE * 2**config.num_bits:
        sides = [prepared(x, id_col, vector_col) for x in (queries, data)]
        q, p = (map_arrow(x, _marked(config, dims), f"id {x.schema['id'].dataType.simpleString()}, vec array<double>") for x in sides)
        return marked_join(q, p, (config.num_tables, config.num_tables), _within(flips), k, config.metric)
    q = buckets(queries, config, dims, id_col, vector_col, True).select("table_no", "bucket", F.col("id").alias("query_id"), F.col("vec").alias("q"))
    if flips:
        masks = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(config.num_bits), n)]
        q = q.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks]))).withColumn("bucket", F.col("bucket").bitwiseXOR(F.col("mask")))
    return group_search(q, buckets(data, config, dims, id_col, vector_col, True), ["table_no", "bucket"], k, config.metric)


def bucket_stats(placed: DataFrame, config: LshConfig) -> DataFrame:
    """One row: possible buckets (a bigint, also at 32 bits), those in use, and their least, greatest and mean size."""
    sizes = placed.groupBy("table_no", "bucket").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.lit(config.num_tables * 2**config.num_bits).cast("bigint").alias("total_buckets"), F.count("*").alias("non_empty"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.round(F.avg("n"), 6).alias("avg_size")
    )
