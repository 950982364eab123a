"""Import and export of vectors, and snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParsingError

ROW = "id string, vector array<double>, metadata map<string,string>"


def parse_vector(text: str) -> list[float]:
    """``[1, 2]`` or ``1,2``."""
    body = text.strip().removeprefix("[").removesuffix("]")
    try:
        return [float(x) for x in body.split(",")] if body.strip() else []
    except ValueError as e:
        raise ParsingError(f"not a vector: {text!r}") from e


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of, or one object per line with, {vector, metadata?, id?}; given ids are kept."""
    return spark.read.schema(ROW).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One object per line: splittable, for large imports."""
    return spark.read.schema(ROW).json(path)


def read_import_body(spark: SparkSession, path: str) -> DataFrame:
    """{vectors: [{vector, metadata?, id?}]}."""
    whole = spark.read.schema(f"vectors array<struct<{ROW.replace('id string', 'id: string').replace('vector array', 'vector: array').replace('metadata map', 'metadata: map')}>>").option("multiLine", True).json(path)
    return whole.select(F.explode("vectors").alias("v")).select("v.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One vector per line: numbers are components, k=v tokens metadata, anything else is ignored, as are header lines (whose
    tokens are neither)."""
    tokens = F.transform(F.split("value", ","), F.trim)
    lines = spark.read.text(path).select(tokens.alias("t"))
    numbers = F.filter(F.transform("t", lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    pairs = F.filter("t", lambda x: x.contains("=") & x.try_cast("double").isNull())
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value")))
    last = F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda s, e: F.concat(F.filter(s, lambda o: o["key"] != e["key"]), F.array(e)))
    return lines.select(F.lit(None).cast("string").alias("id"), numbers.alias("vector"), F.when(F.size(pairs) > 0, F.map_from_entries(last)).alias("metadata")).where(F.size("vector") > 0)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of a file with one vector per line; blank lines and those that start with # are skipped. The id is the
    line's position among all lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("id", "line"))
    body = F.regexp_replace(F.trim("line"), r"^\[|\]$", "")
    own = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    return own.select(F.col("id").cast("bigint").alias("id"), F.transform(F.split(body, ","), lambda x: F.trim(x).cast("double")).alias("vector"))


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, metadata) of lines ``id,[v..],{json}``; either of the latter may be missing."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    pick = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return lines.select(F.trim(F.substring_index("value", ",", 1)).alias("id"), F.from_json(pick(r"(\[[^\]]*\])"), "array<double>").alias("vector"), F.from_json(pick(r"(\{.*\})\s*$"), "map<string,string>").alias("metadata"))


def _text_metadata(rows: DataFrame) -> DataFrame:
    return rows if rows.schema["metadata"].dataType.typeName() == "string" else rows.withColumn("metadata", F.to_json("metadata"))


def write_json(rows: DataFrame, path: str) -> None:
    """{id, vector, metadata?} per line, in as many files as there are partitions."""
    rows = _text_metadata(rows)
    rows.select("id", "vector", F.from_json("metadata", "map<string,string>").alias("metadata")).write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """id, components in one quoted cell, k=v pairs by semicolon; ``read_export`` takes it back."""
    meta = F.from_json(_text_metadata(rows)["metadata"], "map<string,string>")
    pairs = F.array_join(F.transform(F.map_entries(meta), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    _text_metadata(rows).select("id", F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"), pairs.alias("metadata")).write.option("header", True).option("quoteAll", True).csv(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    cells = spark.read.option("header", True).schema("id string, vector string, metadata string").csv(path)
    pairs = F.when(F.col("metadata") != "", F.str_to_map("metadata", F.lit(";"), F.lit("=")))
    return cells.select("id", F.split("vector", ",").cast("array<double>").alias("vector"), pairs.alias("metadata"))


def save_snapshot(rows: DataFrame, path: str, state: dict | None = None, compress: bool = False) -> None:
    """A table as Parquet (gzip if asked), its state as one JSON line beside it."""
    rows.write.option("compression", "gzip" if compress else "snappy").parquet(f"{path}/vectors")
    rows.sparkSession.createDataFrame([(json.dumps(state or {}),)], "value string").write.text(f"{path}/state")


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Rows and state; a snapshot that isn't there is an empty one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/vectors")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "id string, vector array<double>, metadata string"), {}
    state = spark.read.text(f"{path}/state").first()
    return spark.read.parquet(f"{path}/vectors"), json.loads(state["value"]) if state else {}


def snapshot_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: files, bytes and rows of a snapshot."""
    files = spark.read.parquet(f"{path}/vectors").select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
    per = files.groupBy("f", "s").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
