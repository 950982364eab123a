"""Rules for vectors, metadata, names and arguments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError

MAX_DIMENSIONS, MAX_BATCH, MAX_K, MAX_ENTRIES, MAX_KEY, MAX_VALUE, MAX_METADATA, MAX_ID = 10_000, 1000, 1000, 100, 256, 10_000, 1 << 20, 256
_NAME = re.compile(r"^[a-zA-Z0-9]+([_-]?[a-zA-Z0-9]+)*$")


def vector_problem(vec: Column, dimensions: int | None = None, allow_zero: bool = True) -> Column:
    """What is wrong with a vector, null if nothing is."""
    n = F.size(vec)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = F.when(vec.isNull(), "null").when(n == 0, "empty").when(n > MAX_DIMENSIONS, "too long")
    if dimensions is not None:
        out = out.when(n != dimensions, "wrong length")
    out = out.when(bad, "not finite")
    if not allow_zero:
        out = out.when(F.forall(vec, lambda x: x == 0), "zero")
    return out


def metadata_problem(meta: Column) -> Column:
    """What is wrong with a map<string,string>, null if nothing is (or the map is null)."""
    keys, values = F.map_keys(meta), F.map_values(meta)
    total = F.aggregate(F.zip_with(keys, values, lambda k, v: F.octet_length(k) + F.octet_length(v)), F.lit(0), lambda s, x: s + x)
    return (
        F.when(F.size(meta) > MAX_ENTRIES, "too many entries")
        .when(F.exists(keys, lambda k: (F.trim(k) == "") | (F.length(k) > MAX_KEY)), "bad key")
        .when(F.exists(values, lambda v: v.isNull()), "null value")
        .when(F.exists(values, lambda v: F.length(v) > MAX_VALUE), "long value")
        .when(total > MAX_METADATA, "too large")
    )


def problems(data: DataFrame, dimensions: int | None = None, id_col: str = "id", vector_col: str = "vector", allow_zero: bool = True) -> DataFrame:
    """(id, problem) of every row that breaks a rule on vectors."""
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    return data.select(F.col(f"`{id_col}`").alias("id"), vector_problem(vec, dimensions, allow_zero).alias("problem")).where("problem is not null")


def require_valid(data: DataFrame, dimensions: int | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``data``, if all its vectors are valid; else an error that names the first five."""
    found = problems(data, dimensions, id_col, vector_col).limit(5).collect()
    if found:
        raise ValidationError("; ".join(f"{r['id']}: {r['problem']}" for r in found))
    return data


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValidationError(f"k must be between 1 and {MAX_K}")
    return k


def check_dimensions(n: int) -> int:
    if not 1 <= n <= MAX_DIMENSIONS:
        raise ValidationError(f"dimensions must be between 1 and {MAX_DIMENSIONS}")
    return n


def check_id(value: str) -> str:
    if value is None or not str(value).strip() or len(str(value)) > MAX_ID:
        raise ValidationError("an id must not be blank or longer than 256 characters")
    return value


def check_batch(n: int, metadata: list | None = None, ids: list | None = None) -> int:
    """1 to ``MAX_BATCH`` vectors, with as many metadata and ids, if there are any; ids are valid and differ."""
    if not 1 <= n <= MAX_BATCH:
        raise ValidationError(f"a batch must have 1 to {MAX_BATCH} vectors")
    for what, own in (("metadata", metadata), ("ids", ids)):
        if own is not None and len(own) != n:
            raise ValidationError(f"{len(own)} {what} for {n} vectors")
    named = [check_id(i) for i in ids or [] if i is not None]
    if len(set(named)) < len(named):
        raise ValidationError("an id is given twice")
    return n


def check_name(value: str) -> str:
    if not 3 <= len(value or "") <= 64 or not _NAME.match(value):
        raise ValidationError(f"not a valid name: {value!r}")
    return value


def duplicate_ids(data: DataFrame, id_col: str = "id") -> DataFrame:
    return data.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.count("*").alias("n")).where("n > 1")
