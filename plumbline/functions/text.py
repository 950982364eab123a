"""Text functions: tokens and counts, chunking, TF-IDF and sparse retrieval."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..errors import ValidationError
from ..shared import broadcast_if_small, spread, stage
from ..workers import map_arrow


# -- tokens and counts --


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits. A text that starts with a separator has an empty first
    token; empty tokens at the end are dropped; null gives null."""
    return _without_ends(F.split(F.lower(text), r"[\W_]+"), text)


def _without_ends(parts: Column, text: Column) -> Column:
    cut = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when((F.size(cut) == 1) & (cut[0] == "") & (text != ""), F.array().cast("array<string>")).otherwise(cut)


def word_count(text: Column) -> Column:
    """White-space separated words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def line_count(text: Column) -> Column:
    """Line ends and one more; 0 for the empty text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, characters, words, lines) of every row."""
    t = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.length(t), F.lit(0)).alias("characters"), word_count(t).alias("words"), line_count(t).alias("lines"))


# -- chunking --


def chunk_fixed(docs: DataFrame, size: int = 500, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, start, end, chunk): every stride of size - overlap starts a chunk, the last ones included
    even where they hold nothing new. JVM expressions only."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValidationError("size must be positive and overlap at least 0 and below size")
    n = F.length(F.col("t"))
    own = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("t")).where(n > 0)
    started = own.select(id_col, "t", F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).alias("chunk_index", "start"))
    return started.select(id_col, "chunk_index", "start", F.least(F.col("start") + size, n).alias("end"), F.substring("t", F.col("start") + 1, F.lit(size)).alias("chunk"))


_ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "vs", "etc", "e.g", "i.e")
_STOP = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+")
_SHORT = re.compile(r"\b(?:" + "|".join(map(re.escape, _ABBREVIATIONS)) + r")\.$")
_GAP = re.compile(r"\n[ \t\n\x0b\f\r]*\n+")


def sentences(text: str) -> list[tuple[str, int, int]]:
    """(sentence, start, end): cut at white space after . ! or ?, but not after an abbreviation."""
    out, at = [], 0
    for m in _STOP.finditer(text):
        if _SHORT.search(text, max(0, m.start() - 8), m.start()):
            continue
        if own := text[at : m.start()].strip():
            out.append((own, at, m.start()))
        at = m.end()
    if own := text[at:].strip():
        out.append((own, at, len(text)))
    return out


def sentence_chunks(text: str, size: int = 1000, overlap: int = 1) -> list[tuple[str, int, int, int]]:
    """(chunk, start, end, sentences): sentences side by side up to ``size`` characters; a chunk that is over 80 % full
    closes early. The next one starts ``overlap`` sentences back, but always farther than this one did."""
    parts = sentences(text)
    out, i = [], 0
    while i < len(parts):
        first, length = i, 0
        while i < len(parts):
            n = len(parts[i][0])
            if length and length + n > size:
                break
            length += n
            i += 1
            if i < len(parts) and length > size * 0.8:
                break
        out.append(("".join(p[0] for p in parts[first:i]), parts[first][1], parts[i - 1][2], i - first))
        if overlap > 0 and i < len(parts):
            i = max(i - overlap, first + 1)
    return out


def paragraphs(text: str, least: int = 10) -> list[tuple[str, int, int]]:
    """(paragraph, start, end) between blank lines; those of fewer than ``least`` characters are dropped."""
    out, at = [], 0
    for raw in _GAP.split(text):
        own = raw.strip()
        if own:
            start = text.find(own, at)
            at = start + len(own)
            if len(own) >= least:
                out.append((own, start, at))
    if not out and len(text.strip()) >= least:
        out.append((text.strip(), 0, len(text)))
    return out


def paragraph_chunks(text: str, size: int = 2000, overlap: int = 0, least: int = 10) -> list[tuple[str, int, int, int]]:
    """(chunk, start, end, paragraphs): paragraphs joined by a blank line up to ``size`` characters, of which the blank lines
    within count as they are built up; a longer paragraph stands alone, whole."""
    parts = paragraphs(text, least)
    out, i = [], 0
    while i < len(parts):
        first, length = i, 0
        while i < len(parts):
            n = len(parts[i][0])
            if i > first and length + n > size:
                break
            length += n + (2 if i > first else 0)
            i += 1
            if i == first + 1 and n > size:
                break
        out.append(("\n\n".join(p[0] for p in parts[first:i]), parts[first][1], parts[i - 1][2], i - first))
        if overlap > 0 and i < len(parts):
            i = max(i - overlap, first + 1)
    return out


def _chunked(docs: DataFrame, cut: Callable[[str], list[tuple[str, int, int, int]]], id_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("t")).where(F.length("t") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, *c) for k, t in enumerate(b.column(1).to_pylist()) for n, c in enumerate(cut(t))]
            k, n, chunk, start, end, count = zip(*rows) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(k, pa.int64())), *[pa.array(x, pa.int32()) for x in (n, start, end)], pa.array(chunk, pa.string()), pa.array(count, pa.int32())],
                [id_col, "chunk_index", "start", "end", "chunk", "parts"],
            )

    return map_arrow(own, run, f"`{id_col}` {own.schema[id_col].dataType.simpleString()}, chunk_index int, start int, end int, chunk string, parts int")


def chunk_sentences(docs: DataFrame, size: int = 1000, overlap: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, start, end, chunk, parts); greedy packing depends on what went before, hence Arrow batches."""
    return _chunked(docs, lambda t: sentence_chunks(t, size, overlap), id_col, text_col)


def chunk_paragraphs(docs: DataFrame, size: int = 2000, overlap: int = 0, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _chunked(docs, lambda t: paragraph_chunks(t, size, overlap, least), id_col, text_col)


# -- TF-IDF --


def _tokens(docs: DataFrame, id_col: str, text_col: str, *kept: str) -> DataFrame:
    own = spread(docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("txt"), *kept).where("txt is not null"))
    # split once: the cuts at the ends look at the result several times
    parts = own.select("doc", "txt", F.split(F.lower("txt"), r"[\W_]+").alias("parts"), *kept)
    return parts.select("doc", _without_ends(F.col("parts"), F.col("txt")).alias("t"), *kept)


def _counted(tokens: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a batch; row, term and count of each term of each row, by row; and all tokens of each row, an empty first one included."""
    size = np.asarray(pc.list_value_length(tokens), np.int64)
    encoded = tokens.flatten().dictionary_encode()
    terms = encoded.dictionary.to_pylist()
    code = np.asarray(encoded.indices, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    key, count = np.unique(row * max(1, len(terms)) + code, return_counts=True)
    row, code = key // max(1, len(terms)), key % max(1, len(terms))
    real = np.array([t != "" for t in terms], bool)[code] if terms else np.zeros(0, bool)
    return terms, row[real], code[real], count[real], size


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms, _, code, count, _ = _counted(b.column(0))
        n, df = np.bincount(code, count, len(terms)).astype(np.int64), np.bincount(code, minlength=len(terms))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([terms[k] for k in seen], pa.string()), pa.array(n[seen]), pa.array(df[seen])], ["term", "n", "df"])


def tfidf_vocabulary(docs: DataFrame, size: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n, df, idf) of the ``size`` most frequent terms, ties by term; idf is ln(documents / df). Every row is a document.

    Rows are counted batch by batch; only terms and their sums are shuffled."""
    total = docs.agg(F.count("*").alias("docs"))
    terms = map_arrow(_tokens(docs, id_col, text_col).select("t"), _corpus_counts, "term string, n bigint, df bigint")
    terms = terms.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return terms.orderBy(F.desc("n"), "term").limit(size).crossJoin(F.broadcast(total)).select("term", "n", "df", F.log(F.col("docs") / F.col("df")).alias("idf"))


class TfidfModel:
    """A vocabulary on the driver: its size is a parameter, whatever the corpus."""

    def __init__(self, vocabulary: DataFrame):
        rows = vocabulary.select("term", "idf").orderBy("term").collect()
        self.terms = [r["term"] for r in rows]
        self.idf = np.array([r["idf"] for r in rows], np.float64)
        self.number = {t: k for k, t in enumerate(self.terms)}

    def __len__(self) -> int:
        return len(self.terms)

    def weights(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term number and weight of all weights of a batch that aren't zero."""
        terms, row, code, count, size = _counted(tokens)
        number = np.fromiter((self.number.get(t, -1) for t in terms), np.int64, len(terms))[code] if terms else np.zeros(0, np.int64)
        known = number >= 0
        known[known] = self.idf[number[known]] != 0
        row, number, count = row[known], number[known], count[known]
        w = count / size[row] * self.idf[number]
        norm = np.sqrt(np.bincount(row, w * w, len(size)))[row]
        kept = norm >= 1e-10
        return row[kept], number[kept], w[kept] / norm[kept]

    def sparse(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(doc, terms, weights) of every document with a weight, in the row: nothing is shuffled."""
        own = _tokens(docs, id_col, text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, number, w = self.weights(b.column(1))
                rows, first = np.unique(row, return_index=True)
                ends = pa.array(np.append(first, len(row)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(w))], ["doc", "terms", "weights"])

        return map_arrow(own, run, f"doc {own.schema['doc'].dataType.simpleString()}, terms array<int>, weights array<double>")

    def dense(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """(id, vector) of every row, in the order of the terms; zeros where a text has no weight."""
        return self.beside(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text").select("id", "vector")

    def beside(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        """All columns of ``rows`` and the vector of the text: nothing is joined or shuffled."""
        own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("txt"), F.lit(0).alias("none"))
        tokens = _tokens(own, "none", "txt", "row").select("row", "t")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    row, number, w = self.weights(part.column(1))
                    full = np.zeros((part.num_rows, len(self)))
                    full[row, number] = w
                    ends = pa.array((np.arange(part.num_rows + 1) * len(self)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(full.ravel()))], ["row", "vector"])

        fields = [StructField("row", tokens.schema["row"].dataType), StructField("vector", ArrayType(DoubleType()))]
        return map_arrow(tokens, run, StructType(fields)).select("row.*", "vector")


def tfidf_weights(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, term, weight): frequency in the document by its length, times idf, to unit length. Terms that aren't in the
    vocabulary count in the length alone. Zero weights, and documents without any weight, give no rows. Every row is a document."""
    model = TfidfModel(vocabulary)
    own = _tokens(docs, id_col, text_col)
    names = pa.array(model.terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, number, w = model.weights(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), names.take(pa.array(number)), pa.array(w)], ["doc", "term", "weight"])

    return map_arrow(own, run, f"doc {own.schema['doc'].dataType.simpleString()}, term string, weight double")


def _sparse_blocks(rows: int):
    """Blocks (ids, terms, weights, sizes) of sparse rows."""

    def block(part: pa.RecordBatch) -> pa.RecordBatch:
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([one(part.column(0)), one(part.column(1).flatten()), one(part.column(2).flatten()), one(pc.list_value_length(part.column(1)))], ["ids", "terms", "weights", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield block(b.slice(at, rows))

    return run


def sparse_top_k(queries: DataFrame, data: DataFrame, k: int, terms: int) -> DataFrame:
    """(query_id, rank, id, similarity): the k rows of greatest cosine for each query, both as (doc, terms, weights) rows of
    unit length over ``terms`` terms. Pairs without a common term are not candidates; ties go by id.

    Blocks of queries meet blocks of rows, no term is a join key, and k rows a query leave a meeting."""
    kinds = [x.schema["doc"].dataType.simpleString() for x in (queries, data)]
    fields = "ids array<{}>, terms array<int>, weights array<double>, sizes array<int>"
    q = map_arrow(queries, _sparse_blocks(256), fields.format(kinds[0])).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "terms", "weights", "sizes")])
    p = map_arrow(data, _sparse_blocks(4096), fields.format(kinds[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, q_terms, q_weights, q_sizes, ids, number, weights, sizes = (b.column(c)[i].values for c in range(8))
                full = np.zeros((terms, len(q_ids)))
                full[np.asarray(q_terms), np.repeat(np.arange(len(q_ids)), np.asarray(q_sizes))] = np.asarray(q_weights)
                number, weights, sizes = np.asarray(number), np.asarray(weights), np.asarray(sizes, np.int64)
                starts = np.cumsum(sizes) - sizes
                found = np.empty((len(ids), len(q_ids)))
                for at in range(0, len(ids), 128):
                    a, e = starts[at], starts[min(at + 128, len(ids)) - 1] + sizes[min(at + 128, len(ids)) - 1]
                    found[at : at + 128] = np.add.reduceat(full[number[a:e]] * weights[a:e, None], starts[at : at + 128] - a, axis=0)
                shown = np.round(found, 6)
                order = np.argsort(np.array(ids.to_pylist()), kind="stable")
                best = order[np.argsort(-shown[order], axis=0, kind="stable")[:k]]
                c, r = best.ravel(), np.tile(np.arange(len(q_ids)), len(best))
                hit = found[c, r] > 0
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(r[hit])), ids.take(pa.array(c[hit])), pa.array(shown[c, r][hit] + 0.0)], ["query_id", "id", "similarity"])

    pairs = map_arrow(q.crossJoin(p), run, f"query_id {kinds[0]}, id {kinds[1]}, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def retrieve(docs: DataFrame, questions: DataFrame, k: int = 3, size: int = 512, overlap: int = 128, vocabulary_size: int = 10_000, id_col: str = "doc_id", text_col: str = "text", question_id: str = "item_id", question_text: str = "text") -> DataFrame:
    """Chunk, embed and search: the k chunks most similar to each question, with a preview of 200 characters."""
    chunks = chunk_fixed(docs, size, overlap, id_col, text_col).select(F.concat_ws("_", id_col, "chunk_index").alias("chunk_id"), "chunk")
    model = TfidfModel(tfidf_vocabulary(chunks, vocabulary_size, "chunk_id", "chunk"))
    hits = sparse_top_k(model.sparse(questions, question_id, question_text), model.sparse(chunks, "chunk_id", "chunk"), k, len(model))
    # k rows a question; the chunks' texts stay where they are if these are few
    hits = broadcast_if_small(stage(hits, "hits"))
    return chunks.select(F.col("chunk_id").alias("id"), F.substring("chunk", 1, 200).alias("preview")).join(hits, "id").select("query_id", "rank", F.col("id").alias("chunk_id"), "similarity", "preview")
