"""Language-model scoring with a hidden Markov model trained by Baum-Welch.

Every word of every document takes part, and every word has its own emission in every state:

    P(text) = sum over state paths of  prod  P(state | state before) P(word | state)
    P(word | state) = (c(word, state) + PRIOR x base(word, state)) / (c(state) + PRIOR)

where c are the expected counts. The base is a class model, and only smooths and starts the word model. In it, a word
that has over 1 / ``heavy_share`` of all words is a symbol of its own (so there are fewer than ``heavy_share`` of
them in a corpus of any size); the others share ``endings`` symbols by their last two characters, states emit symbols,
and a symbol emits its words by their smoothed corpus frequency:

    base(word, state) = P(symbol | state) P(word | symbol)

The class model is trained first, a few iterations; then the word model, until its likelihood settles. Its counts,
a vector for each word, are a table that grows with the corpus: each block of documents sends those of its
own words to the words' parts, which add them up, and gets the sums back. Both ways are shuffles, packed by (block, part).
What they move is a row for each distinct word of each block, so blocks are large, and their documents are worked on in slabs.

The expectation step runs in every partition over its documents (scaled forward and backward recursions, all
documents of a slab, which are about as long, side by side) and emits expected counts; these are summed across partitions,
and the sums give the next parameters. What is sent to the workers, the transition and the symbol
tables, has a fixed size. The word counts grow with the corpus and are only ever joined, never
broadcast: each block of documents gets the counts of its own words by a shuffle.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cleaned, discard, list_array, narrow, ranges, release, shared_dir, stage, table

STATES, ITERATIONS, HEAVY_SHARE, ENDINGS, SEED = 4, 3, 4096, 1024, 11
#: Text per block of documents, in bytes: of this, words that repeat count once. Words per slab, which are in memory with all their states at once.
BLOCK_BYTES, SLAB_WORDS = 32 << 20, 1_000_000
#: Words' worth of the class model in each state of the word model.
PRIOR = 1.0
#: Training ends when an iteration changes the log likelihood by less than this share; MOST only guards against no end.
SETTLED, MOST = 1e-4, 200
#: (block, word) pairs that a part of the words holds, about.
PART_PAIRS = 400_000
_FLOOR = 1e-12
#: Steps between two scalings of the recursions. A step takes a factor of 1e-34 at most from the largest of the
#: probabilities (a step of ``_FLOOR`` in 1e10 words, to a word seen once in these), so four of them are far from underflow.
SCALED = 4


def _ending(word: str, endings: int) -> int:
    return xxhash.xxh32_intdigest(word[-2:]) % endings


class _Coded:
    """Documents of one block: their words as numbers, in the order of first appearance."""

    def __init__(self):
        self.size = 0
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[pa.Array] = []

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        self.ids.append(ids)
        self.size += texts.nbytes
        # Arrow's white space is Python's; lower case isn't, so it waits for the distinct words
        split = pc.utf8_split_whitespace(texts.fill_null(""))
        words, ends = split.flatten(), np.concatenate([[0], np.cumsum(np.asarray(split.value_lengths()))])
        full = np.asarray(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
        self.lengths.append(np.diff(np.concatenate([[0], np.cumsum(full)])[ends]).astype(np.int32))
        self.parts.append(words if full.all() else words.filter(pa.array(full)))

    def coded(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words in lower case, and the number of every word."""
        parts = pa.chunked_array(self.parts).dictionary_encode().chunks if self.parts else []
        if not parts:  # parts without words are left out
            return pa.array([], pa.string()), np.zeros(0, np.uint32)
        known = pa.array([w.lower() for w in parts[-1].dictionary.to_numpy(zero_copy_only=False)], pa.string()).dictionary_encode()
        number = np.asarray(known.indices).astype(np.uint32)
        return known.dictionary, np.concatenate([number[np.asarray(p.indices)] for p in parts])

    def row(self, endings: int, slab_words: int) -> pa.RecordBatch:
        (known, codes), lengths = self.coded(), np.concatenate(self.lengths)
        self.parts.clear()
        start = np.cumsum(lengths, dtype=np.int64) - lengths
        order = np.argsort(-lengths, kind="stable")
        lengths, start = lengths[order], start[order]
        slab = (np.cumsum(lengths, dtype=np.int64) - lengths) // slab_words
        cuts = [0, *(np.flatnonzero(np.diff(slab)) + 1), len(lengths)]
        packed = [pa.compress(codes[ranges(start[a:b], lengths[a:b])][Layout(lengths[a:b]).source].tobytes(), "zstd", asbytes=True) for a, b in zip(cuts, cuts[1:])]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known.to_numpy(zero_copy_only=False)), np.uint64, len(known)).view(np.int64)
        tails = pc.utf8_slice_codeunits(known, -2).dictionary_encode()
        kinds = np.array([_ending(t, endings) for t in tails.dictionary.to_pylist()], np.int16)[np.asarray(tails.indices)]
        ids = pa.concat_arrays(self.ids).take(pa.array(order))
        one = lambda a: list_array(pa.array(a), np.array([len(a)]))
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                one(lengths), one(np.diff(cuts).astype(np.int32)), pa.array([packed], pa.list_(pa.binary())), one(hashes), one(kinds), one(np.bincount(codes, minlength=len(known)).astype(np.int64)),
            ],
            ["doc_ids", "lengths", "slabs", "codes", "words", "endings", "counts"],
        )


def _encoded(endings: int, block_bytes: int, slab_words: int):
    """A row for each block: its documents, longest first, the word codes of each slab of them, a step of all its documents after the
    other, compressed; and the block's words (64-bit hash, ending, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Coded()
        for batch in chunks(batches, 1, min(block_bytes, 4 << 20)):
            if held.ids and held.size + batch.column(1).nbytes > block_bytes:
                yield held.row(endings, slab_words)
                held = _Coded()
                release()
            held.add(batch.column(0), batch.column(1))
        if held.ids:
            yield held.row(endings, slab_words)
        del held
        release()

    return run


class Layout:
    """Token order in which step t of all documents that are long enough is one slice, longest first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        size = lengths[self.order].astype(np.int64)
        self.longest = int(size[0]) if len(size) else 0
        self.live = np.searchsorted(-size, -np.arange(self.longest), side="left")
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        self.docs = int((size > 0).sum())
        self.lengths, self.size = lengths, size

    @cached_property
    def source(self) -> np.ndarray:
        size, start = self.size, (np.cumsum(self.lengths, dtype=np.int64) - self.lengths)[self.order]
        # token i of document d goes to at[i] + rank(d)
        step = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        source = np.empty(len(step), np.int64)
        source[self.at[step] + np.repeat(np.arange(len(size)), size)] = np.repeat(start, size) + step
        return source

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of a value for each token, by document, longest first."""
        return np.bincount(ranges(np.zeros(self.longest, np.int64), self.live), values, len(self.size))


def _forward(layout: Layout, emitted: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Forward probabilities, scaled at every step number ``SCALED`` only; the scales of these steps, once for each state; and what
    the probabilities at the last word of each document add up to."""
    k = len(first)
    alpha, scales, size = np.empty_like(emitted), [], layout.size[: layout.docs]
    steps, ones, came = np.ascontiguousarray(steps), np.ones((k, k)), np.empty((layout.docs, k))
    live, ends = layout.live.tolist(), layout.at.tolist()
    carry = None
    for t, n in enumerate(live):
        a, b = ends[t], ends[t + 1]
        f = alpha[a:b]
        np.multiply(np.dot(carry[:n], steps, out=came[:n]) if t else first, emitted[a:b], out=f)
        if t % SCALED == SCALED - 1:
            scales.append(np.dot(f, ones))
            np.divide(f, scales[-1], out=f)
        carry = f
    return alpha, scales, alpha[layout.at[size - 1] + np.arange(len(size))].sum(1)


def forward(layout: Layout, emitted: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and scales of all tokens (1 where a step isn't scaled); the log likelihood of a document is
    the sum of its log scales."""
    alpha, scales, left = _forward(layout, np.ascontiguousarray(emitted), first, steps)
    scale, size = np.ones(len(emitted)), layout.size[: layout.docs]
    for t, c in zip(range(SCALED - 1, layout.longest, SCALED), scales):
        scale[layout.at[t] : layout.at[t + 1]] = c[:, 0]
    scale[layout.at[size - 1] + np.arange(len(size))] *= left
    return alpha, scale


def expect(layout: Layout, symbols: np.ndarray, first: np.ndarray, steps: np.ndarray, emission: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of first states, steps and emissions over documents side by side, and their log likelihood.

    The backward recursion keeps one step at a time, and turns the forward probabilities into the
    states' posteriors in their place. A row for each token keeps a step of all documents in one piece."""
    k = len(first)
    emitted = np.take(emission, symbols, axis=0, mode="clip")
    alpha, scales, left = _forward(layout, emitted, first, steps)
    moved, one, back = np.zeros((k, k)), np.empty((k, k)), np.ascontiguousarray(steps.T)
    live, ends = layout.live.tolist(), layout.at.tolist()
    beta, held = np.repeat(1 / left, k).reshape(-1, k), np.empty((layout.docs, k))
    if live:
        alpha[ends[-2] :] *= beta[: live[-1]]
    for t in range(layout.longest - 2, -1, -1):
        a, b, n = ends[t], ends[t + 1], live[t + 1]
        weighted = np.multiply(beta[:n], emitted[b : b + n], out=held[:n])
        if (t + 1) % SCALED == SCALED - 1:
            np.divide(weighted, scales[(t + 1) // SCALED], out=weighted)
        moved += np.dot(alpha[a : a + n].T, weighted, out=one)
        np.dot(weighted, back, out=beta[:n])
        own = alpha[a:b]
        np.multiply(own, beta[: b - a], out=own)
    del emitted
    told = np.stack([np.bincount(symbols, own, len(emission)) for own in alpha.T], axis=1)
    return alpha[: layout.docs].sum(0), steps * moved, told, float(np.log(left).sum() + sum(np.log(c[:, 0]).sum() for c in scales))


@dataclass
class Model:
    """first (K), steps (K x K), emission (symbols x K); the heavy words' hashes, ascending; corpus words and
    distinct words of each symbol; and the corpus count of every word, as a written table (word, ending, n)."""

    first: np.ndarray
    steps: np.ndarray
    emission: np.ndarray
    heavy: np.ndarray
    mass: np.ndarray
    distinct: np.ndarray
    endings: int
    counts: DataFrame
    likelihoods: list[float]

    def symbols(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        return _symbols(self.heavy, hashes, endings)


def _symbols(heavy: np.ndarray, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
    symbols = len(heavy) + endings.astype(np.int64)
    if len(heavy):
        # few words have the last 16 bits of a heavy one, and only these are looked up
        last = np.zeros(1 << 16, bool)
        last[heavy & 0xFFFF] = True
        maybe = np.flatnonzero(last[hashes & 0xFFFF])
        at = np.minimum(np.searchsorted(heavy, hashes[maybe]), len(heavy) - 1)
        hit = heavy[at] == hashes[maybe]
        symbols[maybe[hit]] = at[hit]
    return symbols


def _words(block: pa.RecordBatch | pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(block.column(c)[k].values) for c in ("words", "endings"))


def _slabs(block: pa.RecordBatch | pa.Table, k: int) -> Iterator[tuple[Layout, np.ndarray]]:
    """The slabs of a block: their documents' layout, and their word codes in its order."""
    lengths, codes, at = np.asarray(block.column("lengths")[k].values), block.column("codes")[k].values, 0
    for j, n in enumerate(block.column("slabs")[k].as_py()):
        layout = Layout(lengths[at : at + n])
        at += n
        yield layout, np.frombuffer(pa.decompress(codes[j].as_py(), 4 * int(layout.at[-1]), "zstd"), np.uint32).astype(np.intp)


def _over(slabs: Iterator[tuple[Layout, np.ndarray]], first: np.ndarray, steps: np.ndarray, emission: np.ndarray):
    """What is expected of all slabs, as ``expect`` gives it; emission is that of the block's words."""
    emission = np.ascontiguousarray(emission)
    k = len(first)
    f, moved, told, ll = np.zeros(k), np.zeros((k, k)), np.zeros(emission.shape), 0.0
    for layout, codes in slabs:
        if len(codes):
            got = expect(layout, codes, first, steps, emission)
            f, moved, ll = f + got[0], moved + got[1], ll + got[3]
            told += got[2]
    return f, moved, told, ll


def _expected(first: np.ndarray, steps: np.ndarray, emission: np.ndarray, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            for k in range(batch.num_rows):
                words, endings = _words(batch, k)
                if not len(words):
                    continue
                symbols = _symbols(heavy, words, endings)
                f, moved, c, ll = _over(_slabs(batch, k), first, steps, emission[symbols])
                got = f, moved, np.stack([np.bincount(symbols, own, len(emission)) for own in c.T], axis=1), ll
                totals = got if totals is None else tuple(a + b for a, b in zip(totals, got))
                release()
        if totals is None:
            return
        f, moved, told, ll = totals
        seen = np.flatnonzero(told.any(1))
        # symbol -1: first states; -2 - i: steps from state i; -1000: log likelihood
        key = np.concatenate([[-1], -2 - np.arange(len(f)), [-1000], seen])
        values = np.concatenate([f[None], moved, np.full((1, len(f)), ll), told[seen]])
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *[pa.array(values[:, j]) for j in range(values.shape[1])]], ["symbol", *[f"c{j}" for j in range(values.shape[1])]])

    return run


def encode(docs: DataFrame, endings: int = ENDINGS, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, slab_words: int = SLAB_WORDS) -> DataFrame:
    """Blocks of encoded documents, written to shared storage in buckets, so that reading them by block shuffles nothing."""
    own = narrow(docs, doc_id=id_col, text=text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    made = own.mapInArrow(_encoded(endings, block_bytes, slab_words), f"doc_ids array<{kind}>, lengths array<int>, slabs array<int>, codes array<binary>, words array<bigint>, endings array<smallint>, counts array<bigint>")
    spark, name = docs.sparkSession, f"plumbline_blocks_{uuid.uuid4().hex}"
    to = made.withColumn("block", F.monotonically_increasing_id()).write.format("parquet").bucketBy(_buckets(spark), "block")
    to.option("path", f"{shared_dir(spark)}/stage-{name}").saveAsTable(name)
    return spark.table(name)


def _buckets(spark: SparkSession) -> int:
    return min(100_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def train(blocks: DataFrame, states: int = STATES, iterations: int = ITERATIONS, heavy_share: int = HEAVY_SHARE, endings: int = ENDINGS, seed: int = SEED) -> Model:
    """Baum-Welch over all blocks; the likelihood never falls from one iteration to the next."""
    # added up within each partition first, so that a word that every block has is no hot key
    told = blocks.select(F.explode(F.arrays_zip("words", "endings", "counts")).alias("w"))
    counts = stage(told.groupBy(F.col("w.words").alias("word")).agg(F.first("w.endings").alias("ending"), F.sum("w.counts").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > F.lit(total / heavy_share)).select("word", "n").toArrow()
    order = np.argsort(np.asarray(hot["word"], np.int64))
    heavy = np.asarray(hot["word"], np.int64)[order]
    mass = np.concatenate([np.asarray(hot["n"], np.float64)[order], np.zeros(endings)])
    distinct = np.concatenate([np.ones(len(heavy)), np.zeros(endings)])
    # by the same rule, so it needs no list of the heavy words; at most ``endings`` rows
    for r in counts.where(F.col("n") <= F.lit(total / heavy_share)).groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():
        mass[len(heavy) + r["ending"]], distinct[len(heavy) + r["ending"]] = r["n"], r["d"]

    rng = np.random.default_rng(seed)
    size = len(mass)
    emission = (mass[:, None] + 1) * rng.uniform(0.5, 1.5, (size, states))
    emission /= emission.sum(0)
    first, steps = np.full(states, 1 / states), np.full((states, states), 1 / states) + np.eye(states)
    steps /= steps.sum(1, keepdims=True)
    likelihoods = []
    fields = ", ".join(f"c{j} double" for j in range(states))
    for _ in range(iterations if total else 0):
        sums = blocks.select("lengths", "slabs", "codes", "words", "endings").mapInArrow(_expected(first, steps, emission, heavy), f"symbol int, {fields}")
        rows = sums.groupBy("symbol").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(states)]).toArrow()
        key = np.asarray(rows["symbol"], np.int64)
        values = np.stack([np.asarray(rows[f"c{j}"], np.float64) for j in range(states)], axis=1)
        by = {int(s): values[i] for i, s in enumerate(key) if s < 0}
        first = by[-1] / by[-1].sum()
        moved = np.stack([by[-2 - i] for i in range(states)])
        steps = (moved + _FLOOR) / (moved + _FLOOR).sum(1, keepdims=True)
        emission = np.full((size, states), _FLOOR)
        emission[key[key >= 0]] += values[key >= 0]
        emission /= emission.sum(0)
        likelihoods.append(float(by[-1000][0]))
    return Model(first, steps, emission, heavy, mass, distinct, endings, counts, likelihoods)


_SCORED = ["doc_id", "n_words", "log_likelihood", "perplexity"]


def _scores(block: pa.RecordBatch | pa.Table, k: int, sums: list[np.ndarray]) -> list[pa.Array]:
    """The columns of a block's result; sums are its documents' log likelihoods, slab by slab."""
    ids, lengths, path = block.column("doc_ids")[k].values, np.asarray(block.column("lengths")[k].values), np.concatenate([np.zeros(0), *sums])
    rate = path / np.maximum(lengths, 1)
    return [ids, pa.array(lengths.astype(np.int64)), pa.array(path), pa.array(np.where(lengths > 0, np.exp(np.minimum(-rate, 700)), np.nan), from_pandas=True)]


def _likelihood(first, steps, emission, heavy, mass, distinct):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, endings = _words(batch, k)
                symbols = _symbols(heavy, words, endings)
                n = np.zeros(len(words))
                if batch.column("known")[k].is_valid:
                    known = batch.column("known")[k].values
                    n[np.asarray(known.field("code"))] = np.asarray(known.field("n"))
                # one unseen word is allowed for in every symbol
                word = np.log(n + 1) - np.log(mass + distinct + 1)[symbols]
                own = emission[symbols]
                sums = [layout.sums(np.log(forward(layout, own[codes], first, steps)[1]) + word[codes]) for layout, codes in _slabs(batch, k)]
                yield pa.RecordBatch.from_arrays(_scores(batch, k, sums), _SCORED)
                del sums, own, word
                release()

    return run


def score(blocks: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, log_likelihood, perplexity) of every document of the blocks.

    The likelihood is that of the whole word sequence, by the scaled forward recursion; words are white-space
    separated, in lower case. A null, empty or blank text has no words, log likelihood 0 and a null
    perplexity. Repeated rows, and null ids, are scored each. A word that the model hasn't seen has its symbol's share
    for unseen words.
    """
    # each block gets the counts of its own words
    own = blocks.select("block", F.posexplode("words").alias("code", "word")).join(model.counts, "word")
    known = own.select("block", F.struct("code", "n").alias("k")).groupBy("block").agg(F.collect_list("k").alias("known"))
    joined = blocks.select("block", "doc_ids", "lengths", "slabs", "codes", "words", "endings").join(known, "block", "left")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    run = _likelihood(model.first, model.steps, model.emission, model.heavy, model.mass, model.distinct)
    return joined.mapInArrow(run, f"doc_id {kind}, n_words bigint, log_likelihood double, perplexity double")


@dataclass
class WordModel:
    """first (K), steps (K x K), and the expected counts: of each state (K), and of each word in each state as a written
    table (block, part, data), data being a float for each word of the block in that part and each state, in the order of its codes."""

    classes: Model
    first: np.ndarray
    steps: np.ndarray
    total: np.ndarray
    told: DataFrame
    parts: int
    likelihoods: list[float]


def _split(words: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The codes of a block's words, part by part, and each part that has any: its number, and from where to where its codes are."""
    part = ((words.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    ends = (np.flatnonzero(part[1:] != part[:-1]) + 1).tolist() + [len(part)] if len(part) else []
    return order, [(int(part[a]), a, b) for a, b in zip([0, *ends], ends)]


_SENT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("data", pa.binary())])


def _sent(block: int, words: np.ndarray, values: np.ndarray, parts: int, figures: np.ndarray | None = None) -> pa.Table:
    """A block's values for its words, a row for each part; its figures as part -1."""
    order, split = _split(words, parts)
    words, values = words[order], values.astype(np.float32)[order]
    rows = [(p, block, words[a:b].tobytes(), values[a:b].tobytes()) for p, a, b in split]
    if figures is not None:
        rows.append((-1, block, b"", figures.tobytes()))
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _SENT)], schema=_SENT)


def _add(part: pa.Table) -> pa.Table:
    """The sums over all blocks of the values of a part's words, for each block; of part -1, one row of sums."""
    p, data = part.column("part")[0].as_py(), part.column("data").to_pylist()
    if p < 0:
        total = sum(np.frombuffer(x) for x in data)
        return pa.table([pa.array([p], pa.int32()), pa.array([-1], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "block", "data"])
    words = part.column("words").to_pylist()
    ends = np.cumsum([len(w) // 8 for w in words]).tolist()
    at = np.asarray(pa.array(np.frombuffer(b"".join(words), np.int64)).dictionary_encode().indices).astype(np.intp)
    values = np.frombuffer(b"".join(data), np.float32).reshape(len(at), -1)
    sums = np.stack([np.bincount(at, v) for v in values.T], axis=1).astype(np.float32)[at]
    out = [sums[a:b].tobytes() for a, b in zip([0, *ends], ends)]
    release()
    return pa.table([part.column("part"), part.column("block"), pa.array(out, pa.binary())], ["part", "block", "data"])


def _summed(sent: DataFrame) -> DataFrame:
    return stage(sent.groupBy("part").applyInArrow(_add, "part int, block bigint, data binary"), "word-states")


def _emitted(block: pa.Table, told: pa.Table, classes: tuple, total: np.ndarray | None, parts: int) -> np.ndarray:
    """P(word | state) of a block's words. Without totals, what is told is the words' corpus counts, and the start of training is meant."""
    emission, heavy, mass, distinct = classes
    words, endings = _words(block, 0)
    own = dict(zip(told.column("part").to_pylist(), told.column("data").to_pylist()))
    counts = np.empty((len(words), 1 if total is None else len(total)))
    order, split = _split(words, parts)
    counts[order] = np.frombuffer(b"".join(own[p] for p, _, _ in split), np.float32).reshape(counts.shape)
    symbols = _symbols(heavy, words, endings)
    base = emission[symbols] * ((counts.sum(1) + 1) / (mass + distinct + 1)[symbols])[:, None]
    return base * _jitter(words, base.shape[1]) if total is None else (counts + PRIOR * base) / (total + PRIOR)


def _jitter(words: np.ndarray, states: int) -> np.ndarray:
    """0.5 to 1.5, by word and state: words of a class must start apart, or states that the classes don't tell apart never part."""
    mixed = (words.view(np.uint64)[:, None] ^ np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return 0.5 + (mixed >> np.uint64(40)) / 2.0**24


def _by_block(blocks: DataFrame, told: DataFrame, columns: list[str]):
    placed = told.where("part >= 0").repartition(_buckets(blocks.sparkSession), "block")
    return blocks.select("block", *columns).groupBy("block").cogroup(placed.groupBy("block"))


def _expected_words(first: np.ndarray, steps: np.ndarray, total: np.ndarray | None, classes: tuple, parts: int):
    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        words, _ = _words(block, 0)
        if not len(words):
            return _SENT.empty_table()
        f, moved, c, ll = _over(_slabs(block, 0), first, steps, _emitted(block, told, classes, total, parts))
        release()
        return _sent(block.column("block")[0].as_py(), words, c, parts, np.concatenate([f, moved.ravel(), c.sum(0), [ll]]))

    return run


def train_words(blocks: DataFrame, classes: Model, settled: float = SETTLED, most: int = MOST) -> WordModel:
    """Baum-Welch over all words of all blocks, from the class model on, until the likelihood settles."""
    pairs = blocks.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / PART_PAIRS))
    fixed = (classes.emission, classes.heavy, classes.mass, classes.distinct)
    sent_type = "part int, block bigint, words binary, data binary"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, n = (np.asarray(batch.column(c)[k].values) for c in ("words", "counts"))
                yield from _sent(batch.column("block")[k].as_py(), words, n[:, None], parts).to_batches()

    told = _summed(blocks.select("block", "words", "counts").mapInArrow(counted, sent_type))
    cleaned(blocks.sparkSession)
    first, steps, total, states, likelihoods = classes.first, classes.steps, None, len(classes.first), []
    for _ in range(most if pairs else 0):
        run = _expected_words(first, steps, total, fixed, parts)
        after = _summed(_by_block(blocks, told, ["lengths", "slabs", "codes", "words", "endings"]).applyInArrow(run, sent_type))
        discard(told)
        told = after
        figures = np.frombuffer(bytes(told.where("part < 0").first()["data"]))
        # Spark holds on to the plan that ran last, and so to its shuffles: after another has run, those of the sums can go
        cleaned(blocks.sparkSession)
        first = figures[:states] / figures[:states].sum()
        steps = figures[states : -states - 1].reshape(states, states) + _FLOOR
        steps /= steps.sum(1, keepdims=True)
        total = figures[-states - 1 : -1]
        likelihoods.append(float(figures[-1]))
        # the start isn't quite normalised, so the first likelihood doesn't count
        if len(likelihoods) > 2 and abs(likelihoods[-1] - likelihoods[-2]) < settled * abs(likelihoods[-2]):
            break
    return WordModel(classes, first, steps, total, told, parts, likelihoods)


def score_words(blocks: DataFrame, model: WordModel) -> DataFrame:
    """As ``score``, by the word model, of the blocks that it was trained on."""
    c = model.classes
    first, steps, total, parts, fixed = model.first, model.steps, model.total, model.parts, (c.emission, c.heavy, c.mass, c.distinct)

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        emission = _emitted(block, told, fixed, total, parts) if len(block.column("words")[0]) else np.zeros((0, len(first)))
        sums = [layout.sums(np.log(forward(layout, emission[codes], first, steps)[1])) for layout, codes in _slabs(block, 0)]
        made = pa.table(_scores(block, 0, sums), _SCORED)
        del sums, emission
        release()
        return made

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return _by_block(blocks, model.told, ["doc_ids", "lengths", "slabs", "codes", "words", "endings"]).applyInArrow(run, f"doc_id {kind}, n_words bigint, log_likelihood double, perplexity double")


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", endings: int = ENDINGS, block_bytes: int = BLOCK_BYTES, **options) -> DataFrame:
    """Train on ``docs`` and score each of them. An empty table gives an empty result; other columns play no part."""
    blocks = encode(docs, endings, id_col, text_col, block_bytes)
    classes = train(blocks, endings=endings, **options)
    discard(classes.counts)
    cleaned(docs.sparkSession)
    model = train_words(blocks, classes)
    return score_words(blocks, model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))
