"""One database: a table, an index and searches through it."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ForestConfig, GraphConfig, IndexConfig, IvfConfig, LshConfig, index_config
from .errors import IndexError_, ValidationError
from .functions.validation import MAX_ID, check_batch, check_dimensions, check_k, metadata_problem, require_valid
from .operators import clusters, forest, graph, knn, lsh
from .operators.table import VectorTable, conform


class Engine:
    """Index state is derived from the table, so no row is ever missing from it after a change."""

    def __init__(self, spark: SparkSession, path: str, index: IndexConfig | str = "flat", mode: str = "disk", dimensions: int | None = None):
        self.spark, self.config = spark, index_config(index) if isinstance(index, str) else index
        self.table = VectorTable(spark, path, mode)
        self.dimensions = None if dimensions is None else check_dimensions(dimensions)
        self._state: tuple[int, dict] | None = None

    # -- rows --

    def frame(self, vectors: list, metadata: list[dict | None] | None = None, ids: list[str] | None = None) -> DataFrame:
        import json

        meta = [*(metadata or []), *[None] * len(vectors)][: len(vectors)]
        rows = [(i, [float(x) for x in v], json.dumps(m) if m is not None else None) for i, v, m in zip(ids or [None] * len(vectors), vectors, meta)]
        return self.spark.createDataFrame(rows, "id string, vector array<double>, metadata string")

    def _dims(self) -> int:
        if self.dimensions is None:
            row = self.table.read().select(F.size("vector").alias("n")).first()
            if row is None:
                raise IndexError_("the table is empty")
            self.dimensions = row["n"]
        return self.dimensions

    def _checked(self, rows: DataFrame) -> DataFrame:
        """``rows``, if vectors, ids and metadata keep the rules; the table's own dimensions hold, where it has rows."""
        if self.dimensions is None and self.table.version() > 0:
            row = self.table.read().select(F.size("vector").alias("n")).first()
            self.dimensions = row["n"] if row else None
        rows = conform(rows)
        if self.dimensions is None:
            first = rows.where("vector is not null").select(F.size("vector").alias("n")).first()
            if first:
                self.dimensions = check_dimensions(first["n"])
        meta = F.from_json("metadata", "map<string,string>")
        wrong = F.coalesce(F.when((F.trim("id") == "") | (F.length("id") > MAX_ID), "bad id"), metadata_problem(meta))
        found = rows.select("id", wrong.alias("problem")).where("problem is not null").limit(5).collect()
        if found:
            raise ValidationError("; ".join(f"{r['id']}: {r['problem']}" for r in found))
        return rows

    def insert(self, rows: DataFrame) -> DataFrame:
        """Add rows, or replace those of the same id; their ids, in order."""
        rows = self._checked(rows)
        return self.table.insert(require_valid(rows, self.dimensions))

    def insert_batch(self, vectors: list, metadata: list[dict | None] | None = None, ids: list[str] | None = None) -> list[str]:
        """A batch from the client: at most ``MAX_BATCH`` vectors, and as many metadata and ids, if given."""
        check_batch(len(vectors), metadata, ids)
        return [r["id"] for r in self.insert(self.frame(vectors, metadata, ids)).collect()]

    def update(self, changes: DataFrame) -> DataFrame:
        changes = self._checked(changes)
        require_valid(changes.where("vector is not null"), self.dimensions)
        return self.table.update(changes)

    def delete(self, ids: list[str] | DataFrame) -> bool:
        return self.table.delete(ids)

    def get(self, ident: str) -> dict | None:
        return self.table.get(ident)

    # -- search --

    def _index(self) -> dict:
        """State for the table's present version; large parts are written beside it."""
        now = self.table.version()
        if self._state and self._state[0] == now:
            return self._state[1]
        rows, c, state = self.table.read(), self.config, {}
        beside = f"{self.table.path}/_index-{uuid.uuid4().hex}"

        def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
            (df.write.partitionBy(*by) if by else df.write).parquet(f"{beside}/{name}")
            return self.spark.read.parquet(f"{beside}/{name}")

        if isinstance(c, IvfConfig):
            state["centroids"] = clusters.train(rows, c)
            state["lists"] = kept(clusters.assign(rows, state["centroids"], c.metric), "lists", "cluster_id")
        elif isinstance(c, GraphConfig):
            # ids are strings; their place in id order is the sequence number
            numbered = kept(_numbered(rows), "numbered")
            state["numbered"] = numbered
            state["nodes"] = kept(graph.nodes(numbered.select(F.col("seq").alias("id"), "vector")), "nodes")
            state["edges"] = kept(graph.edges(state["nodes"], c), "edges", "level")
        elif isinstance(c, ForestConfig):
            state["leaves"] = kept(forest.leaves(rows, c, self._dims()), "leaves")
        self._state = now, state
        return state

    def search_all(self, queries: DataFrame, k: int, where: str | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
        """(query_id, rank, id, distance, metadata) for all rows of ``queries``.

        ``where`` is a SQL predicate on (id, metadata); it applies before the search. Metadata is joined to the winners only.
        """
        check_k(k)
        rows, c = self.table.read(), self.config
        data = rows.where(where) if where else rows
        names = {"query_id": id_col, "query_vector": vector_col}
        if isinstance(c, IvfConfig) and not where:
            s = self._index()
            hits = clusters.ivf_search(queries, s["lists"], s["centroids"], k, c.num_probes, c.metric, id_col, vector_col)
        elif isinstance(c, GraphConfig) and not where:
            s = self._index()
            found = graph.graph_search(queries, s["nodes"], s["edges"], c, k, 1, id_col, vector_col)
            hits = found.withColumnRenamed("id", "seq").join(s["numbered"].select("seq", "id"), "seq").drop("seq")
        elif isinstance(c, ForestConfig) and not where:
            q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
            hits = forest.forest_search(q, rows, self._index()["leaves"], c, self._dims(), k)
        elif isinstance(c, LshConfig):
            q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
            hits = lsh.lsh_search(q, data, c, self._dims(), k)
        else:
            hits = knn.knn_join(queries, data, k, c.metric, **names)
        return hits.join(rows.select("id", "metadata"), "id").select("query_id", "rank", "id", "distance", "metadata")

    def search(self, query: list[float], k: int = 10, where: str | None = None) -> list[dict]:
        """Results for one query vector, in rank order: rank, id, distance, similarity (1 - distance) and metadata."""
        if query is None or not len(query):
            raise ValidationError("a query vector is needed")
        if self.table.version() == 0:
            return []
        found = self.search_all(self.frame([query], ids=["q"]), k, where)
        return [{**r.asDict(), "similarity": 1 - r["distance"]} for r in found.drop("query_id").orderBy("rank").collect()]

    def stats(self) -> dict:
        row = self.table.stats().first().asDict()
        return {"storage": row, "index": {"kind": self.config.kind, **asdict(self.config)}}

    def close(self) -> None:
        self.table.forget()


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with seq 0, 1, ... in id order: range partitions are counted, then numbered on their own."""
    from pyspark.sql.window import Window

    ranged = rows.repartitionByRange("id").withColumn("part", F.spark_partition_id()).persist()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "offset")
    own = Window.partitionBy("part").orderBy("id")
    return ranged.join(F.broadcast(offsets), "part").withColumn("seq", (F.col("offset") + F.row_number().over(own) - 1).cast("bigint")).drop("part", "offset")
