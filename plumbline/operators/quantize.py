"""Scalar and product quantization."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QuantizationError, ValidationError
from ..functions.metrics import cosine_distance, pair_distance, squared_euclidean
from ..workers import map_arrow
from .clusters import literal, lloyd
from .knn import crossed, keys_of, knn_join, lists_of, meetings, prepared, top_k
from .nearest import DECIMALS, PAIRS, Nearest


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


class ScalarQuantizer:
    """Each dimension on an even grid between its least and greatest value, of 2**bits steps."""

    def __init__(self, low: Sequence[float], high: Sequence[float], bits: int = 8):
        if not 1 <= bits <= 16:
            raise QuantizationError("bits must be between 1 and 16")
        self.bits, self.low, self.high = bits, list(low), list(high)
        self.steps = 2**bits - 1
        self.scale = [(h - lo) / self.steps if h > lo else 1.0 for lo, h in zip(low, high)]

    @staticmethod
    def params(data: DataFrame, dims: int, vector_col: str = "vector") -> DataFrame:
        """(pos, low, high) of every dimension: one aggregation with a partial result per partition, no explode."""
        v = F.col(f"`{vector_col}`").cast("array<double>")
        one = data.agg(*[f(v[i]).alias(f"{n}{i}") for i in range(dims) for f, n in ((F.min, "lo"), (F.max, "hi"))])
        rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high")) for i in range(dims)])
        return one.select(F.explode(rows).alias("p")).select("p.*")

    @classmethod
    def train(cls, data: DataFrame, dims: int, bits: int = 8, vector_col: str = "vector") -> ScalarQuantizer:
        rows = sorted(cls.params(data, dims, vector_col).collect(), key=lambda r: r["pos"])
        if any(r["low"] is None for r in rows):
            raise QuantizationError("there are no vectors to train on")
        return cls([r["low"] for r in rows], [r["high"] for r in rows], bits)

    def encode(self, vec: Column) -> Column:
        grid = F.arrays_zip(vec.alias("x"), _array(self.low).alias("lo"), _array(self.scale).alias("sc"))
        return F.transform(grid, lambda g: F.greatest(F.lit(0), F.least(F.lit(self.steps), F.floor((g["x"] - g["lo"]) / g["sc"] + 0.5).cast("int"))))

    def decode(self, codes: Column) -> Column:
        return F.zip_with(F.zip_with(codes.cast("array<double>"), _array(self.scale), lambda c, s: c * s), _array(self.low), lambda x, lo: x + lo)

    def distance(self, query: Column, codes: Column) -> Column:
        """Cosine distance of a vector to a decoded one, at least 0."""
        return F.greatest(F.lit(0.0), cosine_distance(query, self.decode(codes)))

    def stats(self) -> dict[str, float]:
        return {"bits": self.bits, "dimensions": len(self.low), "compression_ratio": 64 / self.bits}


class ProductQuantizer:
    """Vectors cut into equal parts, each replaced by the number of its nearest codeword."""

    def __init__(self, codebooks: Sequence[Sequence[Sequence[float]]]):
        self.codebooks = [[[float(x) for x in word] for word in book] for book in codebooks]
        self.parts, self.width = len(codebooks), len(codebooks[0][0])

    @classmethod
    def train(cls, data: DataFrame, dims: int, parts: int = 8, words: int = 256, iterations: int = 100, threshold: float = 0.001, seed: int = 42, id_col: str = "id", vector_col: str = "vector") -> ProductQuantizer:
        if dims % parts:
            raise QuantizationError(f"{dims} dimensions can't be cut into {parts} equal parts")
        return cls(lloyd(prepared(data, id_col, vector_col), words, "euclidean", iterations, threshold, seed, parts=parts))

    def encode(self, vec: Column) -> Column:
        """Codes (array<int>); the lowest number wins a tie."""

        def code(m: int) -> Column:
            part = F.slice(vec, m * self.width + 1, self.width)
            ranked = F.transform(literal(self.codebooks[m]), lambda w, i: F.struct(F.round(squared_euclidean(part, w), 9).alias("d"), i.alias("i")))
            return F.array_min(ranked)["i"]

        return F.array(*[code(m) for m in range(self.parts)])

    def decode(self, codes: Column) -> Column:
        return F.flatten(F.array(*[F.element_at(literal(self.codebooks[m]), codes[m] + 1) for m in range(self.parts)]))

    def search(self, queries: DataFrame, codes: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
        """(query_id, rank, id, distance) by asymmetric distance: a table of squared distances per query, summed by code.

        ``codes`` is (id, codes). That sum is the squared distance to the decoded vector, so this is the exact join with these.
        """
        vectors = codes.select("id", F.col("codes").cast("array<int>").alias("codes"))
        kind = vectors.schema["id"].dataType.simpleString()
        return knn_join(queries, map_arrow(vectors, self._decoded(), f"id {kind}, vector array<double>"), k, "euclidean", id_col, vector_col)

    def _words(self, codes: np.ndarray) -> np.ndarray:
        books = np.array(self.codebooks)
        return books[np.arange(self.parts), codes].reshape(len(codes), -1)

    def _decoded(self):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = self._words(np.asarray(b.column(1).flatten(), np.int64).reshape(b.num_rows, self.parts))
                yield pa.RecordBatch.from_arrays([b.column(0), lists_of(x)], ["id", "vector"])

        return run

    def encoded(self, data: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
        """(id, codes) of every row, in Arrow batches: for large codebooks, of which ``encode`` would make as many literals."""
        books = np.array(self.codebooks)
        own = prepared(data, id_col, vector_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, self.parts, 1, self.width)
                codes = [np.round(((x[k : k + 512] - books[None]) ** 2).sum(3), 9).argmin(2) for k in range(0, len(x), 512)]
                flat = np.concatenate(codes).ravel().astype(np.int32) if codes else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array((np.arange(b.num_rows + 1) * self.parts).astype(np.int32)), pa.array(flat))], ["id", "codes"])

        return map_arrow(own, run, f"id {own.schema['id'].dataType.simpleString()}, codes array<int>")

    def search_reranked(self, queries: DataFrame, data: DataFrame, codes: DataFrame, k: int, spare: int = 20, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
        """(query_id, rank, id, distance): of the ``spare`` x k nearest rows by asymmetric distance the k nearest by their Euclidean distance."""
        own = prepared(data, id_col, vector_col).join(codes.select("id", F.col("codes").cast("array<double>").alias("codes")), "id")
        p = own.select("id", F.concat("vec", "codes").alias("vec"))  # both travel as one, so that no pair needs a vector again
        q = prepared(queries, id_col, vector_col)
        types = [x.schema["id"].dataType.simpleString() for x in (q, p)]
        rough = map_arrow(crossed(q, p), self._rough(spare * k), f"query_id {types[0]}, id {types[1]}, rough double, distance double")
        best = Window.partitionBy("query_id").orderBy("rough", "id")
        near = rough.withColumn("place", F.row_number().over(best)).where(F.col("place") <= spare * k).drop("place", "rough")
        return top_k(near, k).select("query_id", "rank", "id", "distance")

    def _rough(self, k: int):
        """The ``k`` nearest points of a block of queries by asymmetric distance, with both distances."""
        exact = pair_distance("euclidean")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for q_ids, q, met in meetings(batches):
                nearest, ids, vectors, at = Nearest(q, keys_of(q_ids), k, "euclidean"), [], [], 0
                for p_ids, p in met:
                    p, codes = p[:, : -self.parts], p[:, -self.parts :].astype(np.int64)
                    if q.shape[1] != p.shape[1]:
                        raise ValidationError(f"vectors of length {q.shape[1]} and {p.shape[1]}")
                    nearest.add(self._words(codes), keys_of(p_ids), at)
                    ids.append(p_ids), vectors.append(p)
                    at += len(p_ids)
                row, place, d = nearest.result()
                vectors = np.concatenate(vectors)
                true = [np.round(exact(q[row[i : i + PAIRS]], vectors[place[i : i + PAIRS]]), DECIMALS) + 0.0 for i in range(0, len(row), PAIRS)]
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), pa.concat_arrays(ids).take(pa.array(place)), pa.array(d), pa.array(np.concatenate(true or [d]))], ["query_id", "id", "rough", "distance"])

        return run

    def stats(self) -> dict[str, float]:
        return {"parts": self.parts, "words": len(self.codebooks[0]), "compression_ratio": self.width * 8.0}
