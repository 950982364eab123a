"""Helpers shared by the corpus operators: shared storage, safe column names, batching."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, shared_dir, spread, stage
from ..workers import importable

__all__ = ["broadcast_if_small", "shared_dir", "spread", "stage"]

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of ``df``'s, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}_{k}"
    return name


def narrow(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under fixed names: extra or clashing ones never get in."""
    importable(df.sparkSession)
    return df.select(*[df[f"`{c}`"].alias(alias) for alias, c in cols.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """White-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as the empty string."""
    return [s if s is not None else "" for s in column.to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text_col: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Regroup a partition's batches into tables of about ``max_bytes`` of text, so that
    memory is bounded however many rows there are; a single longer text stays whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        per_row = max(1, batch.column(text_col).nbytes // batch.num_rows)
        step = max(1, int(max_bytes // per_row))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            nbytes = per_row * part.num_rows
            if held and size + nbytes > max_bytes:
                yield _join(held)
                held, size = [], 0
            held.append(part)
            size += nbytes
    if held:
        yield _join(held)


def _join(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    whole = pa.Table.from_batches(parts).combine_chunks()
    return whole.to_batches()[0]


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and large blocks leave holes."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` over all pairs."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def list_array(flat: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def discard(*used: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete written tables, or folders, that nothing reads again."""
    for x in used:
        session = spark or x.sparkSession
        for p in [x] if isinstance(x, str) else {f.rsplit("/", 1)[0] for f in x.inputFiles()}:
            where = session._jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)


def cleaned(spark: SparkSession) -> None:
    """Let Spark drop the shuffles of jobs that have ended: it does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()
