"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct word n-grams. Hashing the n-grams into G groups turns it
into a point: how many fall into each group. Two sets share at most the sum over groups of the
smaller of both counts, so for a node of an R-tree over the points, the sum of
min(query, node's largest) bounds every overlap below it. Pairs that keep the bound down to the
points are verified on the true n-gram sets. No pair is lost, at any step.

One R-tree over all points would meet every node with every query. Which points share a tree is therefore
decided first, by a rule that is exact, too:

1. Documents are read once, in blocks; equal sets are found by digest and go on as one.
2. Every n-gram's document frequency is counted over the whole corpus, and comes back to the blocks that have it.
3. In the order of frequency, two sets of Jaccard t or more share one of the first ``size - ceil(t x size) + 1``
   n-grams of each, and meet there; n-grams that only one document has are left out. The first that they share has at least as many n-grams from it to the end,
   in either set, as they must have in common (about three quarters of either, if they are of one size); any other meeting is passed over. A group of near copies meets at hundreds of n-grams, so
   sets are connected first at the ``FIRST`` n-grams of least hash, where the bound of their points allows the threshold. At all the n-grams, then, only sets
   that aren't connected yet make a candidate, which is connected by the same bound. No list of a group's pairs is ever made.
4. Connected sets get their R-tree: each one's n-grams are sent there once. A group of over ``task_grams`` n-grams is cut into
   slices, and every pair of slices gets a tree. Survivors of the bound are verified; links are counted, not listed.

An n-gram that over 2^``hot`` sets may meet at is split into a grid of cells, in which every two of them still meet.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, chunks, cleaned, discard, narrow, ranges, release, shared_dir, spread, stage, strings, table

N, THRESHOLD, GROUPS = 2, 0.6, 64
#: Text of a block; n-grams that meet in one task, about; sets that meet at one n-gram without a grid, as a power of 2.
BLOCK_BYTES, TASK_GRAMS, HOT = 6 << 20, 2_000_000, 16
#: Pairs that are connected on the driver (16 bytes each).
FEW_EDGES = 500_000
_ROW_BITS, _BLOCK_BITS = 23, 20
_LEAST, _MOST = 6, 11
#: n-grams of a set at which it is connected first; more or fewer change no result.
FIRST = 8
_WORD = re.compile(r"\w+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_EPS = 1e-9


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def _words(tokens: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all tokens, end to end, and how many each has."""
    plain = pc.and_(pc.string_is_ascii(tokens), pc.utf8_is_alnum(tokens))
    one = np.asarray(plain)
    lower = np.asarray(pc.ascii_lower(tokens.filter(plain)), object)
    made = [[xxhash.xxh64_intdigest(w) for w in _WORD.findall(t.lower())] for t in np.asarray(tokens.filter(pc.invert(plain)), object)]
    count = np.ones(len(tokens), np.int64)
    count[~one] = np.fromiter(map(len, made), np.int64, len(made))
    flat, single = np.empty(int(count.sum()), np.uint64), np.repeat(one, count)
    flat[single] = np.fromiter(map(xxhash.xxh64_intdigest, lower), np.uint64, len(lower))
    flat[~single] = np.fromiter(chain.from_iterable(made), np.uint64, len(flat) - len(lower))
    return flat, count


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of all texts, end to end, and how many each has.

    A text of fewer than n words has one short gram of all of them."""
    split = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
    encoded = split.flatten().dictionary_encode()
    flat, count = _words(encoded.dictionary)
    code = np.asarray(encoded.indices, np.int64)
    words = flat[ranges((np.cumsum(count) - count)[code], count[code])]
    tokens = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(split.value_lengths(), 0), np.int64))])
    ends = np.concatenate([[0], np.cumsum(count[code])])[tokens]
    length = np.diff(ends)
    h = np.full(len(words), n, np.uint64)
    for i in range(n):
        h[: max(0, len(words) - i)] = _mix(h[: max(0, len(words) - i)] * _M1 + words[i:])
    size = np.where(length >= n, length - n + 1, np.minimum(length, 1))
    grams = h[ranges(ends[:-1], size)]
    starts = np.cumsum(size) - size
    for k in np.flatnonzero((length > 0) & (length < n)):
        own = np.full(1, length[k], np.uint64)
        for w in words[ends[k] : ends[k + 1]]:
            own = _mix(own * _M1 + w)
        grams[starts[k]] = own[0]
    for a, b in zip(starts, starts + size):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[starts[size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return grams[new], kept[starts + size] - kept[starts]


def count_points(grams: np.ndarray, size: np.ndarray, groups: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """How many grams of each set fall into each group, up to ``top``, and how many are above it in all groups together."""
    who = np.repeat(np.arange(len(size)), size)
    full = np.bincount(who * groups + (grams >> np.uint64(40)).astype(np.int64) % groups, minlength=len(size) * groups).reshape(len(size), groups)
    point = np.minimum(full, top)
    return point.astype(np.uint8), size - point.sum(1)


def overlap_bound(a: np.ndarray, b: np.ndarray, a_over: np.ndarray, b_over: np.ndarray) -> np.ndarray:
    """The most that sets with these points can share: the sum of smaller counts."""
    return np.minimum(a, b).sum(1, dtype=np.int64) + np.minimum(a_over, b_over)


def _allowed(a: np.ndarray, b: np.ndarray, bound: Callable, size: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (a, b) can be of the threshold, by sizes and points."""
    ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - _EPS
    at = np.flatnonzero(ok)
    ok[at] = bound(a[at], b[at]) + _EPS >= threshold / (1 + threshold) * (size[a[at]] + size[b[at]])
    return ok


def _in_steps(a: np.ndarray, b: np.ndarray, point: np.ndarray, over: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 24) // point.shape[1])
    parts = [overlap_bound(point[a[k : k + step]], point[b[k : k + step]], over[a[k : k + step]], over[b[k : k + step]]) for k in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Points:
    """Points of sets of all sizes: a large set has more groups, and is folded to as many as its partner has, which gives
    the point that it would have had with so few. Counts go up to 15."""

    def __init__(self, data: bytes, size: np.ndarray):
        self.level = levels(size)
        packed, width = np.frombuffer(data, np.uint8), 1 << self.level >> 1
        starts = np.cumsum(width) - width
        self.at: dict[int, tuple] = {}
        above: tuple = ()
        for level in range(_MOST, _LEAST - 1, -1):
            own = np.flatnonzero(self.level == level)
            half = packed[ranges(starts[own], width[own])].reshape(len(own), -1) if len(own) else np.zeros((0, 1 << level >> 1), np.uint8)
            point = np.stack([half >> 4, half & 15], axis=2).reshape(len(own), 1 << level)
            if above:
                folded = np.minimum(above[1][:, : 1 << level] + above[1][:, 1 << level :], 15)
                own, point = np.concatenate([own, above[0]]), np.concatenate([point, folded])
            above = own, point
            if len(own):
                row = np.full(len(size), -1)
                row[own] = np.arange(len(own))
                self.at[level] = row, point, size[own] - point.sum(1, dtype=np.int64)

    @staticmethod
    def pack(flat: np.ndarray, size: np.ndarray) -> list[bytes]:
        out, starts, level = [b""] * len(size), np.cumsum(size) - size, levels(size)
        for v in np.unique(level):
            own = np.flatnonzero(level == v)
            step = max(1, (1 << 22) >> int(v))
            for k in range(0, len(own), step):
                rows = own[k : k + step]
                point, _ = count_points(flat[ranges(starts[rows], size[rows])], size[rows], 1 << int(v), 15)
                for i, p in zip(rows, point[:, ::2] << 4 | point[:, 1::2]):
                    out[i] = p.tobytes()
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level, out = np.minimum(self.level[a], self.level[b]), np.empty(len(a), np.int64)
        for v in np.unique(level):
            i = np.flatnonzero(level == v)
            row, point, over = self.at[int(v)]
            out[i] = _in_steps(row[a[i]], row[b[i]], point, over)
        return out


def levels(size: np.ndarray) -> np.ndarray:
    """Groups of a set's point, as a power of 2: about one for four n-grams."""
    return np.clip(np.ceil(np.log2(np.maximum(size, 1) / 4)), _LEAST, _MOST).astype(np.int64)


class CountTree:
    """R-tree over count vectors, bulk-loaded: split at the median of the size or of the widest coordinate."""

    def __init__(self, points: np.ndarray, over: np.ndarray, sizes: np.ndarray, leaf: int = 32):
        self.nodes: list[tuple] = []  # (largest counts, largest count above, least size, largest size, children or rows)
        self.points, self.over, self.sizes, self.leaf = points, over, sizes, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        p, s = self.points[rows], self.sizes[rows]
        kids: list[int] | None = None
        if len(rows) > self.leaf:
            spread = p.max(0).astype(int) - p.min(0)
            by = s if s.max() - s.min() >= 2 * spread.max() else p[:, spread.argmax()]
            order = rows[np.argsort(by, kind="stable")]
            half = len(rows) // 2
            kids = [self._build(order[:half]), self._build(order[half:])]
        self.nodes.append((p.max(0), int(self.over[rows].max()), int(s.min()), int(s.max()), kids, rows))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, int]]:
        """(query rows, point row) whose bound allows Jaccard >= threshold, query > point; all queries go down together."""
        share = threshold / (1 + threshold)
        stack = [(self.root, queries)]
        while stack:
            at, q = stack.pop()
            high, over, least, most, kids, rows = self.nodes[at]
            s = self.sizes[q]
            ok = (s >= threshold * least - _EPS) & (s * threshold <= most + _EPS)
            q, s = q[ok], s[ok]
            bound = overlap_bound(self.points[q], high[None, :], self.over[q], over)
            # the smallest total below this node is the easiest to reach
            q = q[bound + _EPS >= share * (s + np.maximum(least, threshold * s))]
            if not len(q):
                continue
            if kids:
                stack += [(k, q) for k in kids]
                continue
            for r in rows:
                mine = q[q > r]
                mine = mine[_allowed(mine, np.full(len(mine), r), lambda a, b: _in_steps(a, b, self.points, self.over), self.sizes, threshold)]
                if len(mine):
                    yield mine, int(r)


class Groups:
    """Sets that links connect; the label is the smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


# -- blocks of texts, frequencies


def _packed(texts: list[str]) -> bytes:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int32, len(raw))
    return zstandard.ZstdCompressor(3).compress(np.int32(len(raw)).tobytes() + size.tobytes() + b"".join(raw))


def _unpacked(data: bytes, rows: np.ndarray | None = None) -> pa.Array:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int32, n, 4), dtype=np.int64)])
    texts = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[4 + 4 * n :])])
    return texts if rows is None else texts.take(pa.array(rows))


def _by_part(distinct: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The parts that grams are in, and where these grams are, in the order of their lower half."""
    part = (distinct >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part << np.uint64(32) | distinct & np.uint64(0xFFFFFFFF))
    part = part.astype(np.int64)
    ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
    for a, b in zip([0, *ends[:-1]], ends):
        yield int(part[order[a]]), order[a:b]


_MADE = "kind tinyint, block bigint, part int, a binary, b binary, ids array<bigint>, marks array<bigint>, digests array<binary>, sizes array<int>"
_TEXTS, _ROWS, _GRAMS = range(3)


def _blocks(n: int, parts: int, block_bytes: int):
    """Of each block a row with its texts, one with its documents, and for each part of the grams one with
    the block's grams in it and in how many documents each is."""

    def row(kind, block, part=None, a=None, b=None, ids=None, marks=None, digests=None, sizes=None):
        return kind, block, part, a, b, ids, marks, digests, sizes

    kinds = [pa.int8(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in _MADE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << _BLOCK_BITS
        for k, batch in enumerate(chunks(batches, 2, block_bytes)):
            block = first + k
            texts = strings(batch.column(2))
            flat, size = gram_sets(pa.array(texts, pa.large_string()), n)
            digests = [xxhash.xxh3_128_digest(part.tobytes()) for part in np.split(flat, np.cumsum(size)[:-1])]
            out = [row(_TEXTS, block, a=_packed(texts)), row(_ROWS, block, ids=batch.column(0).to_pylist(), marks=batch.column(1).to_pylist(), digests=digests, sizes=size.tolist())]
            flat.sort()
            new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
            count = np.diff(np.append(new, len(flat)))
            flat = flat[new]
            for p, at in _by_part(flat, parts):
                own = count[at]
                out.append(row(_GRAMS, block, p, flat[at].astype(np.uint32).tobytes(), own.astype(np.uint8 if own.max() < 256 else np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], names)
            del flat, out, texts
            release()

    return run


def _frequencies(part: pa.Table) -> pa.Table:
    """For each block, the number of documents with each of its grams of this part, as a power of 2 rounded up."""
    tokens = [np.frombuffer(x, np.uint32) for x in part["a"].to_pylist()]
    counts = [np.frombuffer(x, np.uint8 if len(x) == len(t) else np.uint32) for x, t in zip(part["b"].to_pylist(), tokens)]
    _, at = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts))
    code = np.ceil(np.log2(total)).astype(np.uint8)[at]
    out = [x.tobytes() for x in np.split(code, np.cumsum([len(t) for t in tokens])[:-1])]
    release()
    return pa.table([part["block"], part["part"], pa.array(out, pa.binary())], ["block", "part", "a"])


# -- where sets meet

_MET = "kind tinyint, part int, ids binary, sizes binary, points binary, met binary"
_ALL, _EARLY, _POINTS = range(3)


def _squeezed(tokens: np.ndarray, at: np.ndarray, left: np.ndarray) -> bytes:
    """Ascending tokens as steps, with sets and n-grams left, byte by byte of all, compressed."""
    columns = np.stack([np.diff(tokens, prepend=np.uint32(0)), at.astype(np.uint32), left.astype(np.uint32)])
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(columns.view(np.uint8).reshape(3, -1, 4).transpose(0, 2, 1)).tobytes())


def _spread(data: bytes) -> np.ndarray:
    """Tokens, sets and n-grams left, in rows."""
    columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(3, 4, -1).transpose(0, 2, 1)
    columns = np.ascontiguousarray(columns).view(np.uint32)[:, :, 0].copy()
    columns[0] = np.cumsum(columns[0], dtype=np.uint32)
    return columns


def _prefixes(n: int, parts: int, meetings: int, threshold: float, hot: int):
    """Where the sets of a block meet others: by part of the n-grams, for all of them and for the first ones; and the points of these sets."""
    kinds = [pa.int8(), pa.int32(), *[pa.binary()] * 4]
    names = [c.split()[0] for c in _MET.split(", ")]

    def run(text: pa.Table, told: pa.Table) -> pa.Table:
        block = text["block"][0].as_py()
        flat, size = gram_sets(_unpacked(text["a"][0].as_py()), n)
        codes = dict(zip(told["part"].to_pylist(), told["a"].to_pylist()))
        distinct, known = np.unique(flat, return_inverse=True)
        frequency = np.zeros(len(distinct), np.uint8)
        for p, at in _by_part(distinct, parts):
            frequency[at] = np.frombuffer(codes[p], np.uint8)
        frequency = frequency[known]
        # the sets that this block stands for
        rows = np.frombuffer(codes.get(-1, b""), np.int32).astype(np.int64)
        starts = (np.cumsum(size) - size)[rows]
        size = size[rows].astype(np.int64)
        at = ranges(starts, size)
        flat, code = flat[at], frequency[at].astype(np.int64)
        who = np.repeat(np.arange(len(rows)), size)
        order = np.argsort(who * 64 + code, kind="stable")  # by frequency, then hash
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        most = size - np.ceil(threshold * size - _EPS).astype(np.int64) + 1
        used = (rank < np.repeat(most, size)) & (code[order] > 0)
        take = order[used]
        key, code, who_at = flat[take], code[take], who[take]
        left = size[who_at] - rank[used]
        ids = (block << _ROW_BITS) + rows
        out: list[tuple] = []

        def sent(kind: int, key: np.ndarray, who: np.ndarray, left: np.ndarray, points: list[bytes] | None) -> None:
            part = ((key >> np.uint64(32)) % np.uint64(meetings)).astype(np.int64)
            order = np.lexsort((key.astype(np.uint32), part))
            ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
            for a, b in zip([0, *ends[:-1]], ends):
                own = order[a:b]
                mine, at = np.unique(who[own], return_inverse=True)
                packed = b"".join(points[k] for k in mine) if points else None
                out.append((kind, int(part[order[a]]), ids[mine].tobytes(), size[mine].astype(np.int32).tobytes(), packed, _squeezed(key[own].astype(np.uint32), at, left[own])))

        met = np.unique(who_at)
        if len(met):
            place = np.full(len(rows), -1)
            place[met] = np.arange(len(met))
            own = Points.pack(flat[ranges((np.cumsum(size) - size)[met], size[met])], size[met])
            point = [own[k] if k >= 0 else b"" for k in place]
            out.append((_POINTS, -1, ids[met].tobytes(), size[met].astype(np.int32).tobytes(), b"".join(own), None))
            # of those that both sets of a pair of one size can meet at
            cool = np.flatnonzero((code <= hot) & (left + _EPS >= 2 * threshold / (1 + threshold) * size[who_at]))
            order = cool[np.lexsort((_mix(key[cool] * _M1), who_at[cool]))]
            first = np.searchsorted(who_at[order], who_at[order])
            early = order[np.arange(len(order)) - first < FIRST]
            sent(_EARLY, key[early], who_at[early], left[early], point)
        # a hot gram's sets meet in cells of a grid: set of slice s in all (s, .) and (., s)
        for c in np.unique(code[code > hot]):
            slices = 1 << (int(c) - hot)
            at = np.flatnonzero(code == c)
            s = (_mix(ids[who_at[at]].astype(np.uint64) * _M1) % np.uint64(slices)).astype(np.int64)
            other = np.tile(np.arange(slices), len(at))
            s = np.repeat(s, slices)
            cell = np.minimum(s, other) * slices + np.maximum(s, other) + 1
            key = np.concatenate([np.delete(key, at), _mix(np.repeat(key[at], slices) ^ _mix(cell.astype(np.uint64) * _M1))])
            who_at = np.concatenate([np.delete(who_at, at), np.repeat(who_at[at], slices)])
            left = np.concatenate([np.delete(left, at), np.repeat(left[at], slices)])
            code = np.concatenate([np.delete(code, at), np.zeros(len(cell), np.int64)])
        if len(met):
            sent(_ALL, key, who_at, left, None)
        release()
        return pa.table([pa.array(list(c), kind) for c, kind in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    return run


def apart(tokens: np.ndarray, sets: np.ndarray, left: np.ndarray, size: np.ndarray, threshold: float, label: Callable[[], np.ndarray], wide: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that meet at a token, have different labels at the time and, by their sizes and the n-grams left from there on, may be
    of the threshold; in portions, in each of which a pair comes once. Tokens whose sets all have one label take no more than a look at each."""
    order = np.argsort(tokens, kind="stable")
    tokens, sets, left = tokens[order], sets[order], left[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(tokens)))
    starts, count = starts[count > 1], count[count > 1]

    def portion(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = label()[sets[i]] != label()[sets[j]]
        i, j = i[other], j[other]
        a, b = sets[i], sets[j]
        # what they must share is at least the threshold's share of the larger one, so the sizes are within bounds, too
        fits = np.minimum(left[i], left[j]) + _EPS >= threshold / (1 + threshold) * (size[a] + size[b])
        pair = np.unique(np.minimum(a[fits], b[fits]) * len(size) + np.maximum(a[fits], b[fits]))
        return pair // len(size), pair % len(size)

    if len(starts):
        # a group of copies is connected by its neighbours in the order of sets, as a rule
        yield portion(ranges(starts, count - 1), ranges(starts + 1, count - 1))
        own, at = label()[sets[ranges(starts, count)]], np.cumsum(count) - count
        many = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
        starts, count = starts[many], count[many]
    small = count <= wide
    for m in np.unique(count[small]):
        at = starts[small & (count == m)]
        i, j = np.triu_indices(m, 1)
        step = max(1, (1 << 20) // len(i))
        for k in range(0, len(at), step):
            yield portion((at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel())
    for start, m in zip(starts[~small], count[~small]):
        own = sets[start : start + m]
        step = max(1, (1 << 20) // m)
        for k in range(0, m, step):
            mine = label()[own]
            if (mine == mine[0]).all():
                break
            i, j = np.nonzero(mine[k : k + step, None] != mine[None, :])
            yield portion(start + k + i, start + j)


def connect(tokens: np.ndarray, sets: np.ndarray, left: np.ndarray, bound: Callable, size: np.ndarray, threshold: float) -> np.ndarray:
    """Label of each set: sets that share a token and whose points allow the threshold are connected."""
    groups = Groups(len(size))
    for a, b in apart(tokens, sets, left, size, threshold, lambda: groups.label):
        ok = _allowed(a, b, bound, size, threshold)
        groups.link(a[ok], b[ok])
    return groups.label


def _gathered(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and sizes of the sets that meet in a part; and of all meetings the token, the set and the n-grams left, in rows."""
    ids, size = (np.frombuffer(b"".join(part[name].to_pylist()), kind).astype(np.int64) for name, kind in (("ids", np.int64), ("sizes", np.int32)))
    met = [_spread(x).astype(np.int64) for x in part["met"].to_pylist()]
    before = np.cumsum([0, *[len(x) // 8 for x in part["ids"].to_pylist()]])[:-1]
    for m, n in zip(met, before):
        m[1] += n
    return ids, size, np.concatenate(met, axis=1)


def _meet(threshold: float):
    def run(part: pa.Table) -> pa.Table:
        ids, size, met = _gathered(part)
        label = connect(*met, Points(b"".join(part["points"].to_pylist()), size), size, threshold)
        lowest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(lowest, label, ids)
        root = lowest[label]
        linked = root != ids
        release()
        return pa.table({"a": root[linked], "b": ids[linked]})

    return run


def _strangers(threshold: float):
    """Pairs of sets that meet, may be of the threshold, and aren't connected."""

    def run(part: pa.Table, known: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        if part.num_rows:
            ids, size, met = _gathered(part)
            order = np.argsort(ids)
            label = ids.copy()
            label[order[np.searchsorted(ids[order], np.asarray(known["set_id"], np.int64))]] = np.asarray(known["comp"], np.int64)
            for a, b in apart(*met, size, threshold, lambda: label):
                found.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        release()
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        part = np.repeat(np.asarray(batch.column(0)), [len(x) for x in ids])
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))], ["part", "set_id"])


def _pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, sizes, points in zip(*(batch.column(c).to_pylist() for c in range(3))):
            size = np.frombuffer(sizes, np.int32)
            ends = np.concatenate([[0], np.cumsum(1 << levels(size) >> 1)])
            own = [points[a:b] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(size), pa.array(own, pa.binary())], ["set_id", "size", "point"])


def _bounded(threshold: float):
    """Of pairs with their points, those whose points allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                size = np.concatenate([np.asarray(part.column(c), np.int64) for c in (2, 4)])
                points = Points(b"".join([*part.column(3).to_pylist(), *part.column(5).to_pylist()]), size)
                a, b = np.arange(part.num_rows), np.arange(part.num_rows) + part.num_rows
                yield part.select([0, 1]).filter(pa.array(_allowed(a, b, points, size, threshold)))

    return run


# -- verification


def _members(n: int):
    """The grams of the block's sets that are connected with others, for each tree that needs them."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _MEMBER.split(", ")]

    def run(text: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows or not text.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        own = told.sort_by("set_id")
        ids = np.asarray(own["set_id"], np.int64)
        flat, size = gram_sets(_unpacked(text["a"][0].as_py(), ids & ((1 << _ROW_BITS) - 1)), n)
        out = []
        for k, grams in enumerate(np.split(flat, np.cumsum(size)[:-1])):
            comp, unit, slices, s, copies = (own[c][k].as_py() for c in ("comp", "unit", "slices", "slice", "copies"))
            for other in range(slices):
                i, j = min(s, other), max(s, other)
                where = unit if slices == 1 else xxhash.xxh64_intdigest(f"{comp} {i} {j}") >> 1
                out.append((where, comp, i, j, s, int(ids[k]), copies, grams.tobytes()))
        release()
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    return run


_MEMBER = "unit bigint, comp bigint, i int, j int, slice int, set_id bigint, copies bigint, grams binary"


def verified(flat: np.ndarray, size: np.ndarray, side: np.ndarray, groups: int, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(set, other sets, Jaccard of each) of all pairs at the threshold or above; sets of one side only meet those of the other,
    if there are two."""
    point, over = count_points(flat, size, groups, 255)
    order = np.argsort(side, kind="stable")  # so that the searching sets are behind those they may meet
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    first = int((side == side.min()).sum()) if side.min() != side.max() else len(size)
    starts = np.cumsum(size) - size
    _, code = np.unique(flat, return_inverse=True)
    mark = np.zeros(code.max() + 1 if len(code) else 0, bool)
    points, sizes, overs = point[order], size[order], over[order]
    two = first < len(size)
    tree = CountTree(points[:first], overs[:first], sizes[:first])
    if two:  # the tree has one side, the other searches it
        tree.points, tree.over, tree.sizes = points, overs, sizes
    for q, r in tree.search(np.arange(first if two else 0, len(size)), threshold):
        a, q = order[r], order[q]
        own = code[starts[a] : starts[a] + size[a]]
        mark[own] = True
        for k in range(0, len(q), 2048):
            b = q[k : k + 2048]
            hit = mark[code[ranges(starts[b], size[b])]]
            at = np.cumsum(size[b]) - size[b]
            shared = np.add.reduceat(hit, at, dtype=np.int64)
            jaccard = shared / (size[a] + size[b] - shared)
            near = jaccard >= threshold
            if near.any():
                yield int(a), b[near], jaccard[near]
        mark[own] = False


def _links(groups: int, threshold: float, pairs: bool):
    def run(unit: pa.Table) -> pa.Table:
        comp, i, j, side, ids, copies = (np.asarray(unit[c], np.int64) for c in ("comp", "i", "j", "slice", "set_id", "copies"))
        grams = [np.frombuffer(x, np.uint64) for x in unit["grams"].to_pylist()]
        order = np.lexsort((ids, j, i, comp))
        cuts = np.flatnonzero(np.any(np.diff(np.stack([comp, i, j])[:, order], axis=1) != 0, axis=0)) + 1
        a, b, c = [], [], []
        for own in np.split(order, cuts):
            size = np.array([len(grams[k]) for k in own], np.int64)
            if len(own) < 2 or i[own[0]] != j[own[0]] and len(np.unique(side[own])) < 2:
                continue
            links, label = np.zeros(len(own), np.int64), Groups(len(own))
            for x, others, jaccard in verified(np.concatenate([grams[k] for k in own]), size, side[own], groups, threshold):
                if pairs:
                    u, v = np.full(len(others), ids[own[x]]), ids[own[others]]
                    a.append(np.minimum(u, v)), b.append(np.maximum(u, v)), c.append(jaccard)
                    continue
                links[x] += copies[own[others]].sum()
                links[others] += copies[own[x]]
                label.link(np.full(len(others), x), others)
            if not pairs:
                # of a whole group, or of one cell of it
                at = np.flatnonzero(links)
                a.append(ids[own[label.label[at]]]), b.append(ids[own[at]]), c.append(links[at])
        release()
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"a": join(a, np.int64), "b": join(b, np.int64), "c": join(c, np.float64 if pairs else np.int64).astype(np.float64)})

    return run


# -- the join


class _Corpus:
    """Rows, sets and text blocks of the documents, written to shared storage."""

    def __init__(self, docs: DataFrame, n: int, id_col: str, text_col: str, block_bytes: int, task_grams: int):
        spark = docs.sparkSession
        own = spread(narrow(docs, doc_id=id_col, text=text_col).where("doc_id is not null"))
        own = own.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
        chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
        self.n, self.task_grams = n, task_grams
        # a gram takes about seven characters; a task counts the grams of one part at a time
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / (7 * task_grams)))
        self.buckets = min(100_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"plumbline_grams_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/stage-{self.name}"
        made = own.mapInArrow(_blocks(n, self.parts, block_bytes), _MADE)
        # in buckets by block, so that reading texts by block shuffles nothing
        made.write.format("parquet").partitionBy("kind").bucketBy(self.buckets, "block").option("path", self.path).saveAsTable(self.name)
        self.made = spark.table(self.name)
        self.texts = self.made.where(F.col("kind") == _TEXTS).select("block", "a")
        rows = self.made.where(F.col("kind") == _ROWS)
        rows = rows.select("block", F.posexplode(F.arrays_zip("ids", "marks", "digests", "sizes")).alias("row", "r"))
        place = F.shiftleft(F.col("block"), _ROW_BITS) + F.col("row")
        self.rows = stage(rows.select(place.alias("row_id"), F.col("r.ids").alias("doc_id"), F.col("r.marks").alias("mark"), F.col("r.digests").alias("digest"), F.col("r.sizes").alias("size")), "rows")
        sets = self.rows.where("size > 0").groupBy("digest")
        self.sets = stage(sets.agg(F.min("row_id").alias("set_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.min(F.struct("doc_id", "mark")).alias("least")), "sets")

    def by_block(self, told: DataFrame):
        """Texts and ``told``, together by block; only ``told`` is shuffled."""
        return self.texts.groupBy("block").cogroup(told.repartition(self.buckets, "block").groupBy("block"))

    def connected(self, threshold: float, hot: int) -> DataFrame:
        """(set_id, comp) of sets that may have a pair."""
        # at most as many meetings as that in a part, about; there are fewer, as only one document has most n-grams of a prefix
        total = self.sets.agg(F.sum("size")).first()[0] or 0
        meetings = max(16, math.ceil(total * (1 - threshold) / self.task_grams))
        counted = self.made.where(F.col("kind") == _GRAMS).select("block", "part", "a", "b")
        told = counted.groupBy("part").applyInArrow(_frequencies, "block bigint, part int, a binary")
        rows = self.sets.select(F.shiftright("set_id", _ROW_BITS).alias("block"), F.col("set_id").bitwiseAND((1 << _ROW_BITS) - 1).cast("int").alias("row"))
        stands = rows.groupBy("block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
        stands = stands.mapInArrow(_as_bytes, "block bigint, part int, a binary")
        met = self.by_block(told.unionByName(stands)).applyInArrow(_prefixes(self.n, self.parts, meetings, threshold, hot), _MET)
        spark, path = self.made.sparkSession, f"{shared_dir(self.made.sparkSession)}/stage-met-{uuid.uuid4().hex}"
        met.write.partitionBy("kind").parquet(path)
        discard(f"{self.path}/kind={_GRAMS}", spark=spark)
        cleaned(spark)
        met = spark.read.schema(_MET).parquet(path)
        of = lambda kind, *names: met.where(F.col("kind") == kind).select(*names)
        near = of(_EARLY, "part", "ids", "sizes", "points", "met").groupBy("part").applyInArrow(_meet(threshold), "a bigint, b bigint")
        near = stage(near.distinct(), "near")
        early = stage(components(near, "a", "b").select(F.col("doc_id").alias("set_id"), F.col("group_id").alias("comp")), "early")
        known = of(_ALL, "part", "ids").mapInArrow(_placed, "part int, set_id bigint").join(broadcast_if_small(early), "set_id")
        pairs = of(_ALL, "part", "ids", "sizes", "met").groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_strangers(threshold), "a bigint, b bigint")
        points = of(_POINTS, "ids", "sizes", "points").mapInArrow(_pointed, "set_id bigint, size int, point binary")
        side = lambda n: points.select(F.col("set_id").alias(n), F.col("size").alias(f"{n}_size"), F.col("point").alias(f"{n}_point"))
        pairs = stage(pairs.distinct(), "strangers").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_size", "a_point", "b_size", "b_point")
        more = stage(pairs.mapInArrow(_bounded(threshold), "a bigint, b bigint"), "more")
        comps = components(near.unionByName(more), "a", "b")
        discard(near, early, more)
        discard(path, spark=spark)
        return comps.select(F.col("doc_id").alias("set_id"), F.col("group_id").alias("comp"))

    def verified(self, comps: DataFrame, groups: int, threshold: float, pairs: bool = False) -> DataFrame:
        weighed = stage(comps.join(self.sets.select("set_id", "copies", "size"), "set_id"), "connected")
        total = weighed.agg(F.sum("size")).first()[0] or 0
        units = max(int(comps.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / self.task_grams))
        sizes = weighed.groupBy("comp").agg(F.ceil(F.sum("size") / self.task_grams).cast("int").alias("slices")).where("slices > 1")
        placed = weighed.join(broadcast_if_small(stage(sizes, "large-groups")), "comp", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        placed = placed.select(
            F.shiftright("set_id", _ROW_BITS).alias("block"), "set_id", "comp", "copies", "slices",
            F.pmod(F.xxhash64("comp"), F.lit(units)).alias("unit"), F.pmod(F.xxhash64("set_id"), "slices").cast("int").alias("slice"),
        )
        members = self.by_block(placed).applyInArrow(_members(self.n), _MEMBER)
        return stage(members.groupBy("unit").applyInArrow(_links(groups, threshold, pairs), "a bigint, b bigint, c double"), "links")

    def drop(self) -> None:
        self.made.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.path, spark=self.made.sparkSession)
        cleaned(self.made.sparkSession)


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [np.asarray(x.values, np.int32).tobytes() for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, -1, np.int32)), pa.array(data, pa.binary())], ["block", "part", "a"])


def _checked(threshold: float, groups: int) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if groups < 1:
        raise ValueError("groups must be positive")


def _classes(docs: DataFrame, threshold: float, n: int, groups: int, hot: int, id_col: str, text_col: str, block_bytes: int, task_grams: int) -> DataFrame:
    """(doc_id, mark, least, n_links) of all rows with an id; least is the (doc_id, mark) that stands for the class."""
    _checked(threshold, groups)
    corpus = _Corpus(docs, n, id_col, text_col, block_bytes, task_grams)
    comps = corpus.connected(threshold, hot)
    links = corpus.verified(comps, groups, threshold)
    corpus.drop()
    # the cells of a group that was cut have labels of their own, which are links as well
    found = links.groupBy("b").agg(F.sum("c").cast("bigint").alias("links"))
    label = components(links.select("a", "b"), "a", "b").select(F.col("doc_id").alias("b"), F.col("group_id").alias("root"))
    linked = found.join(label, "b").join(corpus.sets.select(F.col("set_id").alias("b"), "least"), "b")
    linked = stage(linked, "linked")
    winner = linked.groupBy("root").agg(F.min("least").alias("winner"))
    linked = linked.join(winner, "root").select(F.col("b").alias("set_id"), "links", "winner")
    whole = corpus.sets.join(linked, "set_id", "left").select("digest", F.coalesce("winner", "least").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = corpus.rows.withColumn("digest", F.when(F.col("size") > 0, F.col("digest")))
    own = F.struct("doc_id", "mark")
    return rows.join(whole, "digest", "left").select("doc_id", "mark", F.coalesce("least", own).alias("least"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def ngram_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    n: int = N,
    groups: int = GROUPS,
    hot: int = HOT,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    task_grams: int = TASK_GRAMS,
) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the class of documents that pairs of n-gram Jaccard >= ``threshold`` connect,
    by its smallest doc_id, and the number of other rows of which this row is such a pair.

    Words are runs of word characters, in lower case; a text of fewer than n words has one gram of
    all of them. Texts without a word (null, empty, blank) are of a class of their own, without links. Every row is a document:
    rows of equal text link to each other, also where they repeat an id; an id with several texts has a row for each. Rows with a null id are
    left out. A pair of exactly the threshold is one. Other columns play no part; an empty table gives no rows.
    """
    found = _classes(docs, threshold, n, groups, hot, id_col, text_col, block_bytes, task_grams)
    return found.select("doc_id", F.col("least.doc_id").alias("class_id"), "n_links")


def ngram_pairs(
    docs: DataFrame, threshold: float = THRESHOLD, n: int = N, groups: int = GROUPS, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, task_grams: int = TASK_GRAMS
) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b or both equal where an id has two texts: the pairs at the threshold between different sets, each of which is
    named by the smallest id that has it. Same rules as ``ngram_join``; as many rows as there are such pairs."""
    _checked(threshold, groups)
    corpus = _Corpus(docs, n, id_col, text_col, block_bytes, task_grams)
    pairs = corpus.verified(corpus.connected(threshold, hot), groups, threshold, True)
    corpus.drop()
    names = corpus.sets.select("set_id", F.col("least.doc_id").alias("id"))
    left, right = names.select(F.col("set_id").alias("a"), F.col("id").alias("x")), names.select(F.col("set_id").alias("b"), F.col("id").alias("y"))
    return pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.col("c").alias("jaccard"))


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b", few: int = FEW_EDGES) -> DataFrame:
    """(doc_id, group_id) of all that the pairs connect; group_id is the group's smallest id. Pairs with a null, and of an id with itself, connect
    nothing; repeated ones count once; without pairs there are no rows.

    Up to ``few`` different pairs, counted first, are connected on the driver; beyond, by large-star and
    small-star steps in turn, each written to shared storage, until nothing changes. The result is the same.
    """
    edges = stage(pairs.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where("u <> v").distinct(), "edges")
    if edges.count() <= few:
        found = edges.toArrow()
        names, at = np.unique(np.concatenate([np.asarray(found["v"], np.int64), np.asarray(found["u"], np.int64)]), return_inverse=True)
        groups = Groups(len(names))
        groups.link(*np.split(at, 2))
        discard(edges)
        # the smallest number of a group is its smallest name
        return edges.sparkSession.createDataFrame(pa.table({"doc_id": names, "group_id": names[groups.label]}))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large-star")
        discard(edges)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).unionByName(
        edges.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct()
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = N, groups: int = GROUPS, hot: int = HOT, block_bytes: int = BLOCK_BYTES, task_grams: int = TASK_GRAMS) -> DataFrame:
    """``docs`` (all columns) with one document of each class of ``ngram_join``: the one of the smallest id.

    A document is an id with a text: rows that repeat both stay or go together, and of an id with two texts one may go.
    Rows with a null id, and texts without a word, are in no class and stay. An empty table stays empty.
    """
    found = _classes(docs, threshold, n, groups, hot, id_col, text_col, block_bytes, task_grams)
    gone = stage(found.where("doc_id <> least.doc_id or mark <> least.mark").select("doc_id", "mark").distinct(), "near-copies")
    mark = F.xxhash64(docs[f"`{text_col}`"])
    return docs.join(broadcast_if_small(gone), (docs[f"`{id_col}`"].cast("bigint") == gone["doc_id"]) & (mark == gone["mark"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{N - 1}], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N} + 1, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
           FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
          WHERE c / (m.n + n.n - c) >= {THRESHOLD}),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents
                         UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, min(other) AS class_id, coalesce(any_value(k), 0)::BIGINT AS n_links
FROM reach LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) ON a = doc_id GROUP BY doc_id
"""
