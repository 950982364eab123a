"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Workers on this machine find the package as the driver does. On other machines it must be
    installed or shipped with ``--py-files``, as any library."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    importable(df.sparkSession)
    return df.mapInArrow(function, schema)
