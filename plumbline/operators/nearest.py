"""The k nearest points of a block of queries, kept up as blocks of points come by.

Once a query has k points, only points that can still come in are measured: a cheap pass over a block names all pairs that may lie within
the query's limit (it errs on the side of too many, by the bounds of its rounding), and these few are measured by the metric itself. So the results are those of
measuring all pairs.
"""

from __future__ import annotations

import numpy as np

from ..functions.metrics import block_distance, pair_distance

DECIMALS = 6
#: Half of the last decimal, and as much again for the rounding of the sums.
_SLACK, _SLACK_SHARE = 1e-6, 1e-9
#: Queries that meet a block of points at once; points that rows without a limit meet at once; pairs that are measured at once.
_ROWS, _FIRST, PAIRS = 256, 256, 1 << 16


class _Products:
    """Metrics that are a matrix product and a term of each side: cosine, dot product, Euclidean, Hamming, Jaccard."""

    def __init__(self, metric: str, q: np.ndarray):
        self.metric, self.mid = metric, q.mean(0) if metric == "euclidean" and len(q) else 0.0
        self.q, self.term = self._sides(q)
        self.size = np.sqrt(np.einsum("ij,ij->i", self.q, self.q) + 1.0)

    def _sides(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.metric in ("hamming", "jaccard"):
            x = (x > 0).astype(np.float64)
            return x, x.sum(1)
        if self.metric == "cosine":
            n = np.sqrt(np.einsum("ij,ij->i", x, x))
            return x / np.where(n == 0, 1.0, n)[:, None], np.zeros(len(x))
        x = x - self.mid
        return x, np.einsum("ij,ij->i", x, x) if self.metric == "euclidean" else np.zeros(len(x))

    def pairs(self, rows: np.ndarray, p: np.ndarray, limit: np.ndarray):
        """(query row, point row) of all pairs within ``limit``, and a few more, by runs of ``rows``."""
        y, term = self._sides(p)
        weight = np.full(len(rows), 0.5 if self.metric in ("euclidean", "hamming") else 0.0)
        if self.metric == "cosine":
            least = 1.0 - limit
        elif self.metric == "dot_product":
            least = -limit
        elif self.metric == "jaccard":
            s = 1.0 - np.minimum(limit, 1.0)
            weight = s / (1.0 + s)
            least = weight * self.term[rows]
        else:
            least = (self.term[rows] - (limit**2 if self.metric == "euclidean" else limit)) / 2
        x = np.concatenate([self.q[rows], -weight[:, None]], axis=1)
        y = np.concatenate([y, term[:, None]], axis=1)
        most = np.sqrt(np.einsum("ij,ij->i", y, y).max(initial=0.0))
        kind = np.float32 if most * self.size[rows].max(initial=0.0) < 1e30 else np.float64
        error = (x.shape[1] + 8) * float(np.finfo(kind).eps) * self.size[rows] * most
        # a limit rounded down would lose pairs
        least = np.nextafter((least - error).astype(kind), kind(-np.inf))[:, None]
        x, y = x.astype(kind), np.ascontiguousarray(y.astype(kind).T)
        for at in range(0, len(rows), _ROWS):
            r, c = np.divmod(np.flatnonzero(x[at : at + _ROWS] @ y >= least[at : at + _ROWS]), len(p))
            yield rows[at + r], c


class _Manhattan:
    """Sums over whole numbers: |a - b| = 2 max(a, b) - a - b, of which the maximum is the only step a pair. A grid step a dimension is the most that rounding takes away."""

    def __init__(self, metric: str, q: np.ndarray):
        finite = q[np.isfinite(q)]
        self.low, high = (float(finite.min()), float(finite.max())) if finite.size else (0.0, 1.0)
        self.levels = max(1, 32_767 // max(1, q.shape[1]))
        self.step = (high - self.low) / self.levels or 1.0
        self.q = self._grid(q)

    def _grid(self, x: np.ndarray) -> np.ndarray:
        # values beyond the grid go to its edge, which makes no difference larger
        return np.ascontiguousarray(np.nan_to_num(np.clip(np.floor((x - self.low) / self.step), 0, self.levels)).astype(np.int16).T)

    def pairs(self, rows: np.ndarray, p: np.ndarray, limit: np.ndarray):
        y = self._grid(p)
        n, dims = len(p), len(y)
        y_sum = y.sum(0, dtype=np.int32)
        for at in range(0, len(rows), 2048):
            own = rows[at : at + 2048]
            x = np.ascontiguousarray(self.q[:, own])
            most = np.floor(np.minimum(limit[at : at + 2048] / self.step * (1 + 1e-9), 1e9)).astype(np.int64) + dims + 1 + x.sum(0, dtype=np.int64)
            # at each shift all queries meet a point each: both sides are read in order
            again = -(-(n + len(own)) // n)
            ring, ring_sum = np.tile(y, again), np.tile(y_sum, again)
            windows = np.lib.stride_tricks.sliding_window_view(ring_sum, len(own))
            both, sums = np.empty_like(x), np.empty((64, len(own)), np.int16)
            for shift in range(0, n, 64):
                step = min(64, n - shift)
                for s in range(step):
                    np.maximum(x, ring[:, shift + s : shift + s + len(own)], out=both)
                    np.add.reduce(both, axis=0, dtype=np.int16, out=sums[s])
                s, r = np.divmod(np.flatnonzero(2 * sums[:step].astype(np.int32) - windows[shift : shift + step] <= most[None, :]), len(own))
                if len(r):
                    yield own[r], (r + shift + s) % n


class _Chebyshev:
    """A pair is within the limit if it is so in every dimension: sets of points up to a value, as bits, of which each query takes two a dimension."""

    EDGES = 64

    def __init__(self, metric: str, q: np.ndarray):
        self.q = q

    def pairs(self, rows: np.ndarray, p: np.ndarray, limit: np.ndarray):
        n, words = len(p), -(-len(p) // 64)
        held = np.zeros((p.shape[1], self.EDGES + 1, words), np.uint64)
        sets, edges = held.view(np.uint8), []
        for d in range(p.shape[1]):
            own = np.sort(p[:, d])[np.linspace(0, n - 1, self.EDGES).astype(np.int64)]
            edges.append(own)
            sets[d, : self.EDGES, : -(-n // 8)] = np.packbits(p[:, d][None, :] <= own[:, None], axis=1, bitorder="little")
        every = np.zeros(words * 8, np.uint8)
        every[: -(-n // 8)] = np.packbits(np.ones(n, bool), bitorder="little")
        every = every.view(np.uint64)
        held[:, self.EDGES] = every
        beyond = np.concatenate([np.broadcast_to(every, (len(held), 1, words)), ~held[:, : self.EDGES]], axis=1)
        for at in range(0, len(rows), _ROWS):
            own, most = self.q[rows[at : at + _ROWS]], limit[at : at + _ROWS]
            found = np.broadcast_to(every, (len(own), words)).copy()
            for d, cut in enumerate(edges):
                found &= held[d][np.searchsorted(cut, own[:, d] + most)]
                found &= beyond[d][np.searchsorted(cut, own[:, d] - most)]
            r, w = np.nonzero(found)
            hit, bit = np.nonzero(np.unpackbits(found[r, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield rows[at + r[hit]], w[hit] * 64 + bit


def _passes(metric: str):
    return {"manhattan": _Manhattan, "chebyshev": _Chebyshev}.get(metric, _Products)


class Nearest:
    """The ``k`` nearest points of each row of ``q``; ties go by key.

    ``rule``: "all", "others" (points of another key than the query's) or "earlier" (smaller keys only).
    """

    def __init__(self, q: np.ndarray, keys: np.ndarray, k: int, metric: str, rule: str = "all"):
        self.q, self.keys, self.k, self.rule = q, keys, k, rule
        self.block, self.exact = block_distance(metric), pair_distance(metric)
        self.least = -np.inf if metric == "dot_product" else 0.0
        self.cheap = _passes(metric)(metric, q)
        self.row, self.d, self.key, self.at = np.zeros(0, np.int64), np.zeros(0), None, np.zeros(0, np.int64)
        self.limit = np.full(len(q), np.inf)
        self.seen = 0
        self.last = None  # the key of the k-th, where there is one

    def add(self, p: np.ndarray, keys: np.ndarray, at: int, allowed=None, rows: np.ndarray | None = None) -> None:
        """Points by their keys; the first one has position ``at``. ``allowed(query rows, point rows)`` tells which pairs count, ``rows`` which queries come into question."""
        rows = np.arange(len(self.q)) if rows is None else rows
        if self.rule == "earlier" and len(keys):
            rows = rows[self.keys[rows] > np.sort(keys)[0]]
        start = 0
        while start < len(p) and len(rows):
            free = np.isinf(self.limit[rows])
            hungry, fed = rows[free], rows[~free]
            # the limits of few points let many pass
            end = min(len(p), start + max(_FIRST, 2 * self.k, self.seen)) if len(hungry) <= len(rows) // 100 else min(len(p), start + max(_FIRST, 2 * self.k))
            self.seen += end - start
            found = []
            for part, finder in ((hungry, self._first), (fed, self._later)):
                for r, c in finder(part, p[start:end], keys[start:end], start, allowed) if len(part) else ():
                    found.append((r, c, self._measure(r, p, c)))
                    if sum(len(f[0]) for f in found) > 1 << 20:
                        self._merge(found, keys, at)
                        found = []
            if found:
                self._merge(found, keys, at)
            start = end

    def _counts(self, r: np.ndarray, c: np.ndarray, keys: np.ndarray, start: int, allowed) -> np.ndarray:
        good = np.ones(len(r), bool)
        if self.rule != "all":
            good &= self.keys[r] != keys[c] if self.rule == "others" else self.keys[r] > keys[c]
        if allowed is not None:
            good[good] = allowed(r[good], c[good] + start)
        return good

    def _first(self, rows, p, keys, start, allowed):
        step = max(1, (1 << 20) // len(p))
        for a in range(0, len(rows), step):
            own = rows[a : a + step]
            d = self.block(self.q[own], p)
            if self.rule != "all" or allowed is not None:
                r, c = np.indices(d.shape).reshape(2, -1)
                d[~self._counts(own[r], c, keys, start, allowed).reshape(d.shape)] = np.inf
            n = min(self.k, len(p))
            cut = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
            r, c = np.nonzero((d <= cut + 2 * (_SLACK + _SLACK_SHARE * np.abs(cut))) & (d < np.inf))
            yield own[r], c + start

    def _later(self, rows, p, keys, start, allowed):
        limit = self.limit[rows]
        for r, c in self.cheap.pairs(rows, p, limit + _SLACK + _SLACK_SHARE * np.abs(limit)):
            good = self._counts(r, c, keys, start, allowed)
            # nothing is nearer than 0: what is kept there goes by key alone
            full = good & (self.limit[r] <= self.least)
            good[full] = keys[c[full]] < self.last[r[full]]
            yield r[good], c[good] + start

    def _measure(self, r, p, c):
        parts = [np.round(self.exact(self.q[r[i : i + PAIRS]], p[c[i : i + PAIRS]]), DECIMALS) + 0.0 for i in range(0, len(r), PAIRS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _merge(self, found: list, keys: np.ndarray, at: int) -> None:
        r, c, d = (np.concatenate(x) for x in zip(*found))
        near = d <= self.limit[r]
        near &= ~np.isnan(d) & (d < np.inf)
        r, c, d = r[near], c[near], d[near]
        if not len(r):
            return
        key = keys[c]
        row, d, place = np.concatenate([self.row, r]), np.concatenate([self.d, d]), np.concatenate([self.at, c + at])
        key = key if self.key is None else np.concatenate([self.key, key])
        by = np.unique(key, return_inverse=True)[1] if key.dtype == object else key
        order = np.lexsort((by, d, row))
        row, d, place, key = row[order], d[order], place[order], key[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < self.k
        self.row, self.d, self.at, self.key = row[kept], d[kept], place[kept], key[kept]
        full = np.flatnonzero(rank[kept] == self.k - 1)
        self.limit[self.row[full]] = self.d[full]
        if self.last is None or self.last.dtype != key.dtype:
            last = np.empty(len(self.q), key.dtype)
            last[self.row[full]] = self.key[full]
            self.last = last
        else:
            self.last[self.row[full]] = self.key[full]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, position, distance), by query, distance and key."""
        return self.row, self.at, self.d
