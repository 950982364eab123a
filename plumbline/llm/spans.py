"""Cache of encoded text spans, shared by the tokenizers.

Spans of text repeat a lot. Each distinct one is encoded once per worker; a batch of texts is
then one dictionary look-up per span and one NumPy gather.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import ranges


class _Codes(dict):
    """Numbers the keys in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        n = self[key] = len(self)
        return n


class SpanCache:
    """``learn`` gives the ids of new spans, end to end, how many each has, and a flag for each. Over ``most``
    spans the cache starts afresh, which bounds memory and changes no result."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], dtype, most: int):
        self.learn, self.dtype, self.most = learn, dtype, most
        self.reset()

    def reset(self) -> None:
        self.known = _Codes()
        self.flat, self.start = np.zeros(0, self.dtype), np.zeros(0, np.int64)
        self.length, self.flag = np.zeros(0, np.int64), np.zeros(0, bool)

    def codes(self, spans: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.known.__getitem__, spans), np.int64, len(spans))
        if self.known.new:
            flat, length, flag = self.learn(self.known.new)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.flat = np.concatenate([self.flat, flat])
            self.length = np.concatenate([self.length, length])
            self.flag = np.concatenate([self.flag, flag])
            self.known.new = []
        return codes

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans, end to end, and how many each has."""
        length = self.length[codes]
        return self.flat[ranges(self.start[codes], length)], length


def per_group(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``lengths`` over consecutive groups of ``counts`` items; 0 for an empty group."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return ends[bounds[1:]] - ends[bounds[:-1]]
