"""A table of (id, vector, metadata) as immutable Parquet versions.

A version is a list of layers: rows, or ids of deleted rows, written once. A change adds a layer of its own size, without rewriting the table; reading
leaves out rows whose id a later layer has. At ``MAX_LAYERS`` the change is merged into one layer again. Readers keep the version they have. A version counts once its
number's entry is written, so a job that dies half way leaves the table as it was. An entry is created exclusively, under
the number after the version that the change was made from: of two writers that start from the same version
one fails with a StorageError, and none is lost. Metadata is JSON text.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..errors import StorageError, ValidationError

SCHEMA = "id string, vector array<double>, metadata string"
#: Layers of a version; the change that would add one more merges them.
MAX_LAYERS = 8
#: An entry of a version that is still empty after so long belongs to a writer that died.
STALE_MS = 60_000


# -- changes as functions of DataFrames --


def conform(rows: DataFrame) -> DataFrame:
    """(id, vector, metadata): a missing or null id is drawn, missing metadata is null, a map or struct becomes JSON."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    drawn = F.uuid() if hasattr(F, "uuid") else F.expr("uuid()")
    ident = F.coalesce(F.col("id").cast("string"), drawn) if "id" in kinds else drawn
    meta = F.lit(None).cast("string") if "metadata" not in kinds else F.to_json("metadata") if kinds["metadata"] in ("map", "struct") else F.col("metadata").cast("string")
    return rows.select(ident.alias("id"), F.col("vector").cast("array<double>").alias("vector"), meta.alias("metadata"))


def once_each(rows: DataFrame) -> DataFrame:
    """Of rows that repeat an id one of the least (vector, metadata)."""
    return rows.groupBy("id").agg(F.min_by(F.struct("vector", "metadata"), F.struct("vector", "metadata")).alias("r")).select("id", "r.vector", "r.metadata")


def upsert(base: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` take the place of rows of the same id; of rows that repeat an id one of the least (vector, metadata) stays."""
    once = once_each(rows)
    return base.join(once.select("id"), "id", "left_anti").unionByName(once)


def update(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A null vector keeps the old one; metadata is replaced, also by null. Unknown ids change nothing."""
    once = changes.groupBy("id").agg(F.min_by(F.struct("vector", "metadata"), F.struct("vector", "metadata")).alias("c"))
    joined = base.join(once, "id", "left")
    hit = F.col("c").isNotNull()
    return joined.select("id", F.coalesce(F.col("c.vector"), F.col("vector")).alias("vector"), F.when(hit, F.col("c.metadata")).otherwise(F.col("metadata")).alias("metadata"))


def update_flags(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, updated) for each change."""
    known = base.select("id", F.lit(True).alias("known"))
    return changes.select("id").join(known, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("updated"))


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("id").distinct(), "id", "left_anti")


def keyset_page(base: DataFrame, size: int, cursor=None, id_col: str = "id") -> tuple[DataFrame, object, bool]:
    """(page, next cursor, has more): ids in order after the cursor; an unknown cursor starts from the beginning.

    The page is sorted and cut on the executors; only its ids come to the driver."""
    if size < 1:
        raise ValidationError("the page size must be at least 1")
    known = cursor is not None and not base.where(F.col(id_col) == F.lit(cursor)).isEmpty()
    rest = base.where(F.col(id_col) > F.lit(cursor)) if known else base
    ids = [r[0] for r in rest.select(id_col).orderBy(id_col).limit(size + 1).collect()]
    more = len(ids) > size
    page = ids[:size]
    rows = rest.where(F.col(id_col) <= F.lit(page[-1])) if page else rest.limit(0)
    return rows.orderBy(id_col), page[-1] if page else None, more


def offset_page(base: DataFrame, page: int = 1, size: int = 20, id_col: str = "id") -> DataFrame:
    """Page ``page`` (from 1) of rows in id order; a size above 100 counts as 100."""
    size = min(100, max(1, size))
    return base.orderBy(id_col).offset((max(1, page) - 1) * size).limit(size)


def page_info(base: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """One row about an offset page: page, size, rows and pages in all, and whether there are pages after and before it."""
    page, size = max(1, page), min(100, max(1, size))
    pages = F.ceil(F.col("total") / size).cast("bigint")
    return base.agg(F.count("*").alias("total")).select(
        F.lit(page).alias("page"), F.lit(size).alias("size"), "total", pages.alias("pages"), (pages > page).alias("has_next"), F.lit(page > 1).alias("has_previous")
    )


def storage_stats(base: DataFrame, vector_col: str = "vector", metadata_col: str | None = "metadata") -> DataFrame:
    """One row: vectors, bytes (8 per component and the metadata's) and the range of dimensions."""
    extra = F.coalesce(F.octet_length(F.col(metadata_col)), F.lit(0)) if metadata_col else F.lit(0)
    return base.agg(
        F.count("*").alias("vectors"), F.coalesce(F.sum((F.size(vector_col) * 8 + extra).cast("bigint")), F.lit(0)).alias("bytes"),
        F.min(F.size(vector_col)).alias("min_dimensions"), F.max(F.size(vector_col)).alias("max_dimensions"),
    )


# -- the table --


@dataclass
class VectorTable:
    """A versioned table under ``path``; ``mode``: disk, memory (cached) or hybrid (cached up to ``cache_bytes`` of files,
    read from disk beyond)."""

    spark: SparkSession
    path: str
    mode: str = "disk"
    cache_bytes: int = 1 << 30

    def __post_init__(self):
        self._cached: tuple[int, DataFrame] | None = None
        self.hits = self.misses = 0

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _entries(self) -> list[str]:
        fs, path_of = self._fs()
        log = path_of(f"{self.path}/_versions")
        return sorted(s.getPath().getName() for s in fs.listStatus(log) if s.getLen()) if fs.exists(log) else []

    def version(self) -> int:
        """Number of the present version; 0 before the first."""
        entries = self._entries()
        return int(entries[-1]) if entries else 0

    def _layers(self, version: int) -> list[str]:
        """Folders of a version, oldest first: v... has rows, g... has ids of deleted ones."""
        return self.spark.read.text(f"{self.path}/_versions/{version:09d}").first()[0].split() if version else []

    def _merged(self, version: int) -> DataFrame:
        out = later = None
        for name in reversed(self._layers(version)):
            rows = self.spark.read.schema(SCHEMA if name[0] == "v" else "id string").parquet(f"{self.path}/{name}")
            if name[0] == "v":
                part = rows if later is None else rows.join(later, "id", "left_anti")
                out = part if out is None else out.unionByName(part)
            later = rows.select("id") if later is None else later.unionByName(rows.select("id"))
        return self.spark.createDataFrame([], SCHEMA) if out is None else out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the present one."""
        now = self.version() if version is None else version
        if now == 0:
            return self.spark.createDataFrame([], SCHEMA)
        if self.mode != "disk" and self._cached is not None and self._cached[0] == now:
            self.hits += 1
            return self._cached[1]
        rows = self._merged(now)
        if self.mode == "disk" or self.mode == "hybrid" and self._bytes(now) > self.cache_bytes:
            self.misses += self.mode != "disk"
            return rows
        self.forget()
        self.misses += 1
        self._cached = now, rows.persist(StorageLevel.MEMORY_AND_DISK)
        return self._cached[1]

    def _bytes(self, version: int) -> int:
        fs, path_of = self._fs()
        return sum(fs.getContentSummary(path_of(f"{self.path}/{n}")).getLength() for n in self._layers(version))

    def cache_stats(self) -> dict:
        """Readings from the cache and past it, and the share of the former; 0 before the first."""
        total = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "hit_rate": self.hits / total if total else 0.0, "cached": self._cached is not None}

    def disk_stats(self) -> dict:
        """Bytes, files and layers of the present version."""
        now = self.version()
        fs, path_of = self._fs()
        found = [fs.getContentSummary(path_of(f"{self.path}/{n}")) for n in self._layers(now)]
        return {"version": now, "bytes": sum(x.getLength() for x in found), "files": sum(x.getFileCount() for x in found), "layers": len(found)}

    def forget(self) -> None:
        """Drop the cached reading."""
        if self._cached:
            self._cached[1].unpersist()
            self._cached = None

    def preload(self, ids: list[str] | None = None) -> int:
        """Read rows (None: all) into the cache; how many there are."""
        rows = self.read()
        return (rows if ids is None else rows.where(F.col("id").isin(ids))).count()

    def commit(self, rows: DataFrame, base: int | None = None) -> int:
        """Write the version after ``base``, the version that ``rows`` were made from (by default the present one), as one layer."""
        base = self.version() if base is None else base
        name = f"v{uuid.uuid4().hex}"
        rows.select("id", "vector", "metadata").write.parquet(f"{self.path}/{name}")
        return self._enter([name], base, name)

    def _enter(self, layers: list[str], base: int, new: str) -> int:
        """The version after ``base``; if another writer has made it, ``new`` goes and an error is raised."""
        fs, path_of = self._fs()
        fs.mkdirs(path_of(f"{self.path}/_versions"))
        entry = path_of(f"{self.path}/_versions/{base + 1:09d}")
        if fs.exists(entry) and (old := fs.getFileStatus(entry)).getLen() == 0 and time.time() * 1000 - old.getModificationTime() > STALE_MS:
            fs.delete(entry, False)  # of a writer that died between creating and filling it
        try:
            out = fs.create(entry, False)
        except Py4JJavaError as e:
            fs.delete(path_of(f"{self.path}/{new}"), True)
            raise StorageError("the table has changed meanwhile") from e
        out.write(bytearray(" ".join(layers).encode()))
        out.close()
        return base + 1

    def _change(self, layer: DataFrame, kind: str, base: int, whole) -> DataFrame:
        """Add a layer to version ``base``, or merge it (``whole`` of the written layer gives the rows); the layer as written."""
        name, layers = f"{kind}{uuid.uuid4().hex}", self._layers(base)
        layer.write.parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(layer.schema).parquet(f"{self.path}/{name}")
        if len(layers) < MAX_LAYERS:
            self._enter([*layers, name], base, name)
        else:
            self.commit(whole(written), base)
        return written

    def insert(self, rows: DataFrame) -> DataFrame:
        """Add rows, or replace those of the same id; their ids (one column), in order. The table itself is not read."""
        incoming, now = f"{self.path}/incoming-{uuid.uuid4().hex}", self.version()
        conform(rows).write.parquet(incoming)  # drawn ids are settled by writing them, once
        settled = self.spark.read.schema(SCHEMA).parquet(incoming)
        written = self._change(once_each(settled), "v", now, lambda new: upsert(self._merged(now), new))
        fs, path_of = self._fs()
        fs.delete(path_of(incoming), True)
        return written.select("id").orderBy("id")

    def update(self, changes: DataFrame) -> DataFrame:
        """Apply (id, vector, metadata) changes; (id, updated) of each."""
        now = self.version()
        rows, changes = self.read(now), conform(changes)
        flags = update_flags(rows, changes)
        hit = rows.join(changes.select("id"), "id", "left_semi")
        self._change(update(hit, changes), "v", now, lambda new: upsert(self._merged(now), new))
        return flags

    def delete(self, ids: list[str] | DataFrame) -> bool:
        """Whether all of them were there; the others go either way."""
        gone = ids.select(F.col("id").cast("string").alias("id")) if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        now = self.version()
        written = self._change(gone.where("id is not null").distinct(), "g", now, lambda new: delete(self._merged(now), new))
        return self._merged(now).join(written, "id", "left_semi").count() == written.count()

    def get(self, ident: str) -> dict | None:
        """A row by its id: the predicate reaches the Parquet scan."""
        row = self.read().where(F.col("id") == ident).first()
        return None if row is None else {"id": row["id"], "vector": list(row["vector"]), "metadata": json.loads(row["metadata"]) if row["metadata"] else None}

    def ids(self, limit: int | None = None) -> DataFrame:
        rows = self.read().select("id").orderBy("id")
        return rows.limit(limit) if limit and limit > 0 else rows

    def stream_ids(self):
        return (r["id"] for r in self.ids().toLocalIterator())

    def page(self, size: int, cursor: str | None = None) -> tuple[DataFrame, str | None, bool]:
        return keyset_page(self.read(), size, cursor)

    def stats(self) -> DataFrame:
        return storage_stats(self.read())
