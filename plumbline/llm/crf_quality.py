"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line gets features of its own and of its neighbours; the field labels it good or bad. Its
forward-backward marginals, weighted by line length, add up to the document's quality.

The field is fitted on a bounded sample of labelled documents (``max_docs``, those of the smallest hashed id),
whose lines take their document's label; everything else reads all documents, whole, in one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import importable
from .common import chunks, list_array, narrow, release, spread, strings, table

MAX_DOCS, STEPS, KEEP = 2000, 120, 0.5
_SYMBOL, _PIPE, _SHOUT, _UPPER, _DIGIT, _SPACE, _STOP, _LOWER = range(1, 9)
_CLASS = np.zeros(256, np.uint8)
for _chars, _k in ((b"*#$%&^~<>{}[]=@\\_+`", _SYMBOL), (b"|", _PIPE), (b"!", _SHOUT), (bytes(range(65, 91)), _UPPER), (b"0123456789", _DIGIT), (b" \t", _SPACE), (b".,;:?", _STOP), (bytes(range(97, 123)), _LOWER)):
    for _c in _chars:
        _CLASS[_c] = _k
#: Own features of a line, then four of them for the line before and the line after.
OWN = 13
_NEAR = [1, 2, 3, 7]
FEATURES = OWN + 2 * len(_NEAR)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES), lengths and numbers of the non-blank lines of all texts, end to end, and
    how many each text has."""
    all_lines = [t.split("\n") for t in texts]
    raw = ("\n".join(texts) + "\n").encode("utf-8", "replace") if texts else b""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    size = ends - starts
    kind = _CLASS[data]
    # a line's newline belongs to no class, so sums over [start, next start) are the line's own
    share = {k: np.add.reduceat(kind == k, starts, dtype=np.int64) / np.maximum(size, 1) for k in range(1, 9)} if len(starts) else {}
    n = len(starts)
    words, repeats, distinct = np.zeros(n), np.zeros(n), np.zeros(n)
    seen_again = np.zeros(n)
    number = np.zeros(n, np.int64)
    counts = np.zeros(len(texts), np.int64)
    full = np.zeros(n, bool)
    at = 0
    for d, lines in enumerate(all_lines):
        seen: set[str] = set()
        for k, line in enumerate(lines):
            w = line.split()
            if w:
                full[at] = True
                counts[d] += 1
                words[at] = len(w)
                repeats[at] = sum(map(eq, w, islice(w, 1, None)))
                distinct[at] = len(set(w))
                seen_again[at] = line in seen
                seen.add(line)
            number[at] = k
            at += 1
    if not n:
        return np.zeros((0, FEATURES)), size, number, counts
    last = kind[np.maximum(ends - 1, 0)]
    own = np.stack(
        [
            np.ones(n),
            np.minimum(1, 4 * (share[_SYMBOL] + share[_PIPE])),
            share[_UPPER],
            np.minimum(1, 8 * (share[_PIPE] + share[_SHOUT])),
            share[_DIGIT],
            np.minimum(1, 4 * share[_SHOUT]),
            share[_STOP],
            repeats / np.maximum(words - 1, 1),
            np.log1p(distinct) / np.log1p(np.maximum(words, 1)),
            np.log1p(words) / 8,
            last == _STOP,
            seen_again,
            np.minimum(2, (size - words) / np.maximum(words, 1) / 8),
        ],
        axis=1,
    )[full]
    bounds = np.cumsum(counts)
    first, final = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[(bounds - counts)[counts > 0]] = True
    final[bounds[counts > 0] - 1] = True
    before, after = np.zeros((len(own), len(_NEAR))), np.zeros((len(own), len(_NEAR)))
    before[1:] = own[:-1][:, _NEAR]
    after[:-1] = own[1:][:, _NEAR]
    before[first] = 0
    after[final] = 0
    return np.concatenate([own, before, after], axis=1), size[full], number[full], counts


class Field:
    """Two labels (0 bad, 1 good); the score of a labelling is the sum of line and step scores."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.weights = np.zeros((FEATURES, 2)) if weights is None else weights
        self.steps = np.zeros((2, 2)) if steps is None else steps

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(label) of every line, expected steps, and the log partition sum; all documents advance together."""
        scores = x @ self.weights
        top = scores.max(1, keepdims=True) if len(scores) else scores
        e, a = np.exp(scores - top), np.exp(self.steps)
        order = np.argsort(-counts, kind="stable")
        counts = counts[order]
        start = (np.cumsum(counts[np.argsort(order)]) - counts[np.argsort(order)])[order]
        longest = int(counts[0]) if len(counts) else 0
        live = np.searchsorted(-counts, -np.arange(longest), side="left")
        fwd, scale, bwd = np.zeros_like(e), np.ones(len(e)), np.ones_like(e)
        carry = None
        for t in range(longest):
            i = start[: live[t]] + t
            f = e[i] if t == 0 else (carry[: live[t]] @ a) * e[i]
            c = f.sum(1)
            carry = f / c[:, None]
            fwd[i], scale[i] = carry, c
        for t in range(longest - 2, -1, -1):
            i = start[: live[t + 1]] + t
            bwd[i] = ((bwd[i + 1] * e[i + 1]) @ a.T) / scale[i + 1][:, None]
        post = fwd * bwd
        post /= post.sum(1, keepdims=True)
        inner = np.ones(len(e), bool)
        inner[start[counts > 0]] = False
        j = np.flatnonzero(inner)
        pairs = a * (fwd[j - 1].T @ (bwd[j] * e[j] / scale[j][:, None]))
        return post, pairs, float(np.log(scale).sum() + top.sum())

    @classmethod
    def fit(cls, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-3) -> Field:
        """Maximum likelihood by Adam; ``labels`` (0 or 1) are the lines'."""
        field = cls()
        if not len(x):
            return field
        y = np.eye(2)[labels]
        inner = np.ones(len(x), bool)
        ends = np.cumsum(counts)
        inner[(ends - counts)[counts > 0]] = False
        j = np.flatnonzero(inner)
        told_w, told_s = x.T @ y, y[j - 1].T @ y[j]
        m, v = [0.0, 0.0], [0.0, 0.0]
        for k in range(1, steps + 1):
            post, pairs, _ = field.marginals(x, counts)
            grads = ((told_w - x.T @ post) / len(x) - decay * field.weights, (told_s - pairs) / len(x) - decay * field.steps)
            moved = []
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                moved.append(rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8))
            field.weights = field.weights + moved[0]
            field.steps = field.steps + moved[1]
        return field


def _sampled(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, chunk_bytes):
            x, _, _, counts = line_features(strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts), list_array(pa.array(x.ravel().astype(np.float32)), counts * FEATURES)], ["doc_id", "label", "lines", "x"]
            )

    return run


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chunk_bytes: int = 8 << 20) -> Field:
    """The field fitted on at most ``max_docs`` labelled documents; of rows that repeat an id in ``labels``
    the smallest label counts; other labels than 0 and 1, and null ids, don't; of documents that repeat an id each is used; texts without a line add nothing. Without labelled documents every line is as likely good as bad."""
    known = narrow(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    own = narrow(docs, doc_id=id_col, text=text_col).join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = own.mapInArrow(_sampled(chunk_bytes), f"doc_id {kind}, label int, lines bigint, x array<float>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("lines", "ascending")])
    counts = np.asarray(rows["lines"], np.int64)
    x = np.asarray(rows["x"].combine_chunks().flatten(), np.float64).reshape(-1, FEATURES) if len(rows) else np.zeros((0, FEATURES))
    return Field.fit(x, counts, np.repeat(np.asarray(rows["label"], np.int64), counts))


def _scored(field: Field, keep: float, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, chunk_bytes):
            x, size, number, counts = line_features(strings(batch.column(1)))
            post, _, _ = field.marginals(x, counts)
            good = post[:, 1]
            owner = np.repeat(np.arange(len(counts)), counts)
            weight = np.bincount(owner, size, len(counts))
            quality = np.bincount(owner, good * size, len(counts)) / np.maximum(weight, 1)
            bad = good < 0.5
            n_bad = np.bincount(owner[bad], minlength=len(counts))
            none = counts == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.where(none, 0.0, quality)),
                    pa.array(~none & (quality >= keep)),
                    pa.array(counts.astype(np.int32)),
                    list_array(pa.array(number[bad].astype(np.int32)), n_bad),
                ],
                ["doc_id", "quality", "keep", "n_lines", "bad_lines"],
            )

    return run


def classify(docs: DataFrame, field: Field, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, quality, keep, n_lines, bad_lines) of every row.

    quality is the length-weighted mean probability that a line is good; bad_lines numbers (from 0) the lines
    more likely bad than good (a line at exactly a half is good). Blank lines don't count; a text without any other (null, empty, blank) has
    quality 0 and isn't kept. Repeated rows, and rows with a null id, are classified each; an empty table gives none. Other
    columns play no part.
    """
    own = spread(narrow(docs, doc_id=id_col, text=text_col))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_scored(field, keep, chunk_bytes), f"doc_id {kind}, quality double, keep boolean, n_lines int, bad_lines array<int>")


def _kept(field: Field, keep: float, text_at: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_at, chunk_bytes):
            x, size, _, counts = line_features(strings(batch.column(text_at)))
            post, _, _ = field.marginals(x, counts)
            owner = np.repeat(np.arange(len(counts)), counts)
            quality = np.bincount(owner, post[:, 1] * size, len(counts)) / np.maximum(np.bincount(owner, size, len(counts)), 1)
            yield batch.filter(pa.array((counts > 0) & (quality >= keep)))
            del x, post, owner
            release()

    return run


def keep_good(docs: DataFrame, field: Field, keep: float = KEEP, text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` (all columns) that ``classify`` keeps, in one pass: a quality of exactly ``keep`` is enough, texts without a line go, repeated
    rows are judged each, ids play no part. The text's column is found whatever the case of its name, the exact one first."""
    importable(docs.sparkSession)
    at = docs.columns.index(text_col) if text_col in docs.columns else [c.lower() for c in docs.columns].index(text_col.lower())
    # mapInArrow asks for its columns by name, and reads a name with a dot as a path
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).mapInArrow(_kept(field, keep, at, chunk_bytes), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
