"""Vector metrics as Spark columns, and the same ones over NumPy blocks for all-pairs work.

Every metric has a *distance* (smaller is nearer). The column forms stay in the JVM; use them on pairs
that a join has made. Both forms agree to the last few bits, hence callers compare rounded distances.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ValidationError


def vector(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def checked(a: Column, b: Column, value: Column) -> Column:
    """``value``, or an error where lengths differ: zip_with would pad the shorter one with nulls."""
    text = F.concat(F.lit("vectors of length "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(F.size(a) != F.size(b), F.raise_error(text)).otherwise(value)


def dot_product(a: Column, b: Column) -> Column:
    return checked(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine_similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """In [-1, 1]; 0 if either vector is zero. Norms may be given where they are stored with the vectors."""
    product = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(product == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot_product(a, b) / product)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def squared_euclidean(a: Column, b: Column) -> Column:
    return checked(a, b, _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot_product(a, b)


def manhattan_distance(a: Column, b: Column) -> Column:
    return checked(a, b, _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def chebyshev_distance(a: Column, b: Column) -> Column:
    return checked(a, b, F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0)))


def hamming_distance(a: Column, b: Column) -> Column:
    """Dimensions in which just one of both is positive."""
    return checked(a, b, F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) != (y > 0)), lambda x: x)).cast("double"))


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Of the sets of positive dimensions; two empty sets are equal."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) & (y > 0)), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) | (y > 0)), lambda x: x))
    return checked(a, b, F.when(either == 0, F.lit(1.0)).otherwise(both / either))


def jaccard_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - jaccard_similarity(a, b)


def normalize(a: Column, kind: str = "l2") -> Column:
    """Divided by the L1, L2 or greatest absolute norm; a zero vector stays as it is."""
    kinds = {"l1": _sum(F.transform(a, F.abs)), "l2": norm(a), "max": F.array_max(F.transform(a, F.abs))}
    if kind.lower() not in kinds:
        raise ValidationError(f"unknown norm: {kind}")
    size = kinds[kind.lower()]
    return F.when(F.coalesce(size, F.lit(0.0)) == 0, a).otherwise(F.transform(a, lambda x: x / size))


# -- blocks -----------------------------------------------------------------------------------


def _by_rows(pairwise: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.empty((len(q), len(p)))
        step = max(1, (1 << 21) // max(1, p.size))
        for at in range(0, len(q), step):
            out[at : at + step] = pairwise(q[at : at + step, None, :], p[None, :, :])
        return out

    return run


def _cosine_block(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    nq, np_ = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (q, p))
    product = nq[:, None] * np_[None, :]
    return 1.0 - np.clip(np.where(product == 0, 0.0, (q @ p.T) / np.where(product == 0, 1.0, product)), -1.0, 1.0)


def _euclidean_block(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    mid = p.mean(0) if len(p) else 0.0  # keeps the product form well conditioned
    q, p = q - mid, p - mid
    d = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", p, p)[None, :] - 2 * (q @ p.T)
    return np.sqrt(np.maximum(d, 0))


def _hamming_block(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    a, b = (q > 0).astype(float), (p > 0).astype(float)
    return a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)


def _jaccard_block(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    a, b = (q > 0).astype(float), (p > 0).astype(float)
    both = a @ b.T
    either = a.sum(1)[:, None] + b.sum(1)[None, :] - both
    return 1.0 - np.where(either == 0, 1.0, both / np.where(either == 0, 1.0, either))


def _cosine_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    product = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
    return 1.0 - np.clip(np.where(product == 0, 0.0, np.einsum("ij,ij->i", a, b) / np.where(product == 0, 1.0, product)), -1.0, 1.0)


def _jaccard_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both, either = ((a > 0) & (b > 0)).sum(1), ((a > 0) | (b > 0)).sum(1)
    return 1.0 - np.where(either == 0, 1.0, both / np.maximum(either, 1))


#: name: (distance of two columns, distances of all pairs of two blocks, distances of paired rows)
_METRICS: dict[str, tuple] = {
    "cosine": (cosine_distance, _cosine_block, _cosine_pairs),
    "euclidean": (euclidean_distance, _euclidean_block, lambda a, b: np.sqrt(np.einsum("ij,ij->i", a - b, a - b))),
    "dot_product": (dot_distance, lambda q, p: -(q @ p.T), lambda a, b: -np.einsum("ij,ij->i", a, b)),
    "manhattan": (manhattan_distance, _by_rows(lambda q, p: np.abs(q - p).sum(2)), lambda a, b: np.abs(a - b).sum(1)),
    "chebyshev": (chebyshev_distance, _by_rows(lambda q, p: np.abs(q - p).max(2)), lambda a, b: np.abs(a - b).max(1, initial=0)),
    "hamming": (hamming_distance, _hamming_block, lambda a, b: ((a > 0) != (b > 0)).sum(1).astype(float)),
    "jaccard": (jaccard_distance, _jaccard_block, _jaccard_pairs),
}
_ALIASES = {"dot": "dot_product"}
METRICS = tuple(_METRICS)


def metric_name(name: str) -> str:
    """The registered name, whatever the case; an unknown one raises rather than fall back."""
    found = _ALIASES.get(str(name).lower(), str(name).lower())
    if found not in _METRICS:
        raise ValidationError(f"unknown metric {name!r}; there are {', '.join(METRICS)}")
    return found


def distance(metric: str, a: Column, b: Column) -> Column:
    return _METRICS[metric_name(metric)][0](a, b)


def block_distance(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return _METRICS[metric_name(metric)][1]


def pair_distance(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of paired rows."""
    return _METRICS[metric_name(metric)][2]


SQL_FUNCTIONS = {
    "vec_dot": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_euclidean": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "vec_manhattan": "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)",
    "vec_chebyshev": "array_max(zip_with(a, b, (x, y) -> abs(x - y)))",
    "vec_cosine": "1D - coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), "
    "sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)",
}


def register_sql(spark) -> list[str]:
    """Metrics as SQL functions of two arrays, inlined by the optimizer."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    return sorted(SQL_FUNCTIONS)
