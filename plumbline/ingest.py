"""Documents into a searchable table: parse, chunk, embed, insert.

An embedder is anything with ``fit(texts)`` and ``embed(texts)``, both on (id, text) tables; the TF-IDF embedder is
built in, others (a model, a remote service) plug in here.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .errors import ValidationError
from .functions import text
from .sources.documents import read_documents


@runtime_checkable
class Embedder(Protocol):
    def fit(self, texts: DataFrame) -> Embedder:
        """Learn from an (id, text) table what ``embed`` needs; itself."""

    def embed(self, texts: DataFrame) -> DataFrame:
        """(id, vector) of every row of an (id, text) table."""

    @property
    def dimensions(self) -> int: ...


class TfidfEmbedder:
    """Unit vectors of TF-IDF weights over the ``size`` most frequent terms; a text without any weight has zeros."""

    def __init__(self, size: int = 10_000):
        self.size, self._model = size, None

    def fit(self, texts: DataFrame) -> TfidfEmbedder:
        self._model = text.TfidfModel(text.tfidf_vocabulary(texts, self.size, "id", "text"))
        return self

    @property
    def model(self) -> text.TfidfModel:
        if self._model is None:
            raise ValidationError("the embedder is not fitted")
        return self._model

    def embed(self, texts: DataFrame) -> DataFrame:
        return self.model.dense(texts)

    def embed_rows(self, rows: DataFrame, text_col: str) -> DataFrame:
        """The rows themselves, each with its vector."""
        return self.model.beside(rows, text_col)

    @property
    def dimensions(self) -> int:
        return len(self.model)


@dataclass(frozen=True)
class Chunking:
    """``strategy``: fixed, sentence or paragraph; size in characters; overlap in characters, sentences or paragraphs."""

    strategy: str = "fixed"
    size: int = 500
    overlap: int = 50

    def __post_init__(self):
        if self.strategy not in ("fixed", "sentence", "paragraph"):
            raise ValidationError(f"unknown chunking: {self.strategy}")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(chunk_id, doc_id, chunk_index, start, end, chunk, chunk_size, strategy, max_size, overlap)."""
        how = {"fixed": text.chunk_fixed, "sentence": text.chunk_sentences, "paragraph": text.chunk_paragraphs}[self.strategy]
        own = how(docs, self.size, self.overlap, id_col=id_col, text_col=text_col)
        return own.select(
            F.concat_ws("_", id_col, "chunk_index").alias("chunk_id"), F.col(f"`{id_col}`").alias("doc_id"), "chunk_index", "start", "end", "chunk",
            F.length("chunk").alias("chunk_size"), F.lit(self.strategy).alias("strategy"), F.lit(self.size).alias("max_size"), F.lit(self.overlap).alias("overlap"),
        )


def embedded_chunks(docs: DataFrame, embedder: Embedder, chunking: Chunking = Chunking(), fit: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks of all documents, and the vector of each. An embedder with ``embed_rows`` sets it beside the chunk; the vectors of others are joined."""
    chunks = chunking.apply(docs, id_col, text_col)
    texts = chunks.select(F.col("chunk_id").alias("id"), F.col("chunk").alias("text"))
    if fit:
        embedder.fit(texts)
    if hasattr(embedder, "embed_rows"):
        return embedder.embed_rows(chunks, "chunk")
    return chunks.join(embedder.embed(texts).withColumnRenamed("id", "chunk_id"), "chunk_id")


def ingest(engine: Engine, docs: DataFrame, embedder: Embedder, chunking: Chunking = Chunking(), fit: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunk, embed and insert documents; the ids of the chunks, in order. The metadata of a row has where its chunk comes from, and the chunk."""
    own = embedded_chunks(docs, embedder, chunking, fit, id_col, text_col)
    about = [F.col(c).cast("string").alias(c) for c in ("doc_id", "chunk_index", "start", "end", "strategy", "chunk")]
    return engine.insert(own.select(F.col("chunk_id").alias("id"), "vector", F.to_json(F.struct(*about)).alias("metadata")))


def ingest_files(spark: SparkSession, engine: Engine, path: str, embedder: Embedder, chunking: Chunking = Chunking(), fit: bool = True) -> DataFrame:
    """(doc_id, filename, chunks, error) of every file under ``path``: those that can be parsed go in, the others have their error."""
    files = read_documents(spark, path)
    ids = ingest(engine, files.where("error is null"), embedder, chunking, fit)
    counted = ids.select(F.regexp_replace("id", r"_\d+$", "").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return files.join(counted, "doc_id", "left").select("doc_id", "filename", F.coalesce("chunks", F.lit(0)).alias("chunks"), "error")


def answer(engine: Engine, embedder: Embedder, questions: DataFrame, k: int = 3, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, id, similarity, chunk): the chunks nearest to each question; similarity is 1 - distance."""
    asked = embedder.embed(questions.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    found = engine.search_all(asked, k)
    return found.select("query_id", "rank", "id", (1 - F.col("distance")).alias("similarity"), F.get_json_object("metadata", "$.chunk").alias("chunk"))
