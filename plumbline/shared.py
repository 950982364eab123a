"""Storage that all executors share, for results that later steps read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``.

    Only where that is unset and the master is a single local JVM (tests) is a
    temporary folder made; on a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="plumbline-")
    return "file://" + _LOCAL[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A side of a join is broadcast up to this many narrow rows, counted first; beyond, it is shuffled.
BROADCAST_ROWS = 200_000


def broadcast_if_small(staged: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``staged`` (a written, narrow table) with a broadcast hint if its counted rows allow it."""
    return F.broadcast(staged) if staged.count() <= most else staged


#: Inputs up to this size by the optimizer's estimate, often a single file with one row group, are dealt out to all cores first.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it is small; larger inputs have partitions enough and are not shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= small else df
