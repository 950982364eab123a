"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A piece file gives the pieces and their scores. The best segmentation of a text maximises the
sum of its pieces' log scores; characters that no piece covers become UTF-8 byte pieces
(byte fallback). White space is the marker U+2581, with one put in front of every text, and
decoding takes both back.

The best segmentation of a text is the concatenation of the best ones of its spans, where no
piece crosses from one span to the next. Such cuts are derived from the pieces themselves, so
the result is that of the whole text. Spans repeat a lot, so each distinct one is segmented once
per worker, thousands at a time: the lattice of all of them is filled position by position with
NumPy over the trie's arrays.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, list_array, narrow, ranges, release, spread, strings, table
from .spans import SpanCache, per_group

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What a byte piece costs beyond the worst piece, as for an unknown character.
PENALTY = 10.0
_NEG = -1e30
#: Spans that a worker keeps, and text that it takes at once, in bytes: a worker may stand beside those of other stages, in an executor whose heap is full.
MOST_SPANS, CHUNK_BYTES = 200_000, 1 << 20
_SPACED = re.compile(r" *[^ ]+| +")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


def read_model(path: str) -> tuple[list[str], list[float], list[int], bool]:
    """Pieces, log scores and types of a model file, and whether its scores were merge ranks.

    A unigram model's scores are log probabilities and are taken as they are. A merge model has
    negative ranks instead; by Zipf's law the piece of rank r has log score -log(r + 1) - log(H).
    """
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, model_type = [], [], [], 1
    for field, v in _fields(data):
        if field == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, x in _fields(v):
                if k == 1:
                    text = x.decode("utf-8")
                elif k == 2:
                    score = float(np.frombuffer(x, "<f4")[0])
                elif k == 3:
                    kind = x
            pieces.append(text)
            scores.append(score)
            kinds.append(kind)
        elif field == 2:
            model_type = next((x for k, x in _fields(v) if k == 3), 1)
    if model_type == 2:
        normal = [i for i, k in enumerate(kinds) if k in (NORMAL, USER)]
        # float32, as a model file holds them
        zipf = np.float32(-np.log(np.arange(1, len(normal) + 1)) - np.log(np.sum(1 / np.arange(1, len(normal) + 1))))
        by_rank = sorted(normal, key=lambda i: (-max(scores[i], -1e8), i))
        for r, i in enumerate(by_rank):
            scores[i] = float(zipf[r])
    return pieces, scores, kinds, model_type == 2


class DoubleArray:
    """Trie over UTF-8 bytes as two arrays: child of s by byte c is t = base[s] + c, if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        root: dict = {}
        for key, value in keys.items():
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1 << 16
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        queue, first, dense = [(0, root)], 257, 257
        for s, node in queue:
            kids = sorted(c for c in node if c >= 0)
            if -1 in node:
                self.value[s] = node[-1]
            if not kids:
                continue
            while used[first]:
                first += 1
            # an only child fills the first hole; brothers search on from where holes are not yet rare
            b = (first if len(kids) == 1 else max(first, dense)) - kids[0]
            tries = 0
            while True:
                if b + 600 >= len(used):
                    self._grow()
                    used.extend(bytes(len(self.base) - len(used)))
                if not any(used[b + c] for c in kids):
                    break
                b += 1
                tries += 1
            if tries > 100:
                dense = b + kids[0]
            self.base[s] = b
            for c in kids:
                used[b + c] = 1
                self.check[b + c] = s
                queue.append((b + c, node[c]))

    def _grow(self) -> None:
        n = len(self.base)
        self.base = np.concatenate([self.base, np.zeros(n, np.int32)])
        self.check = np.concatenate([self.check, np.full(n, -1, np.int32)])
        self.value = np.concatenate([self.value, np.full(n, -1, np.int32)])

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is no child."""
        to = self.base[states] + codes
        return np.where(self.check[to] == states, to, -1)


class Unigram:
    """One model, with the pieces of every span seen so far (``most`` spans at a time)."""

    def __init__(self, path: str = MODEL, most: int = MOST_SPANS):
        self.pieces, self.scores, self.kinds, _ = read_model(path)
        own = {p.encode(): i for i, p in reversed(list(enumerate(self.pieces))) if self.kinds[i] in (NORMAL, USER)}
        self.trie = DoubleArray(own)
        self.score = np.array(self.scores, np.float64)
        self.longest = max(map(len, own), default=1)
        self.byte_id = np.full(256, self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0, np.int32)
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == BYTE:
                self.byte_id[int(p[1:-1], 16)] = i
        self.fallback = min((self.scores[i] for i in own.values()), default=0.0) - PENALTY
        self.split = re.compile(self._cuts(own))
        self.surface = pa.array([self._surface(i) for i in range(len(self.pieces))], pa.binary())
        self.leads = np.array([s[:1] == b" " and k != UNKNOWN for s, k in zip(self.surface.to_pylist(), self.kinds)])
        self.parts = SpanCache(self._segment, np.int32, most)
        self.words = SpanCache(self._learn, np.int32, most)

    def _cuts(self, own: dict[bytes, int]) -> str:
        """Pattern of spans: a cut lies before a marker that follows no marker, around a line end, and between
        a letter and punctuation, unless some piece has it inside."""
        texts = [k.decode() for k in own]
        space = not any(a != MARK and b == MARK for t in texts for a, b in zip(t, t[1:]))
        line = not any("\n" in t and len(t) > 1 for t in texts)
        if not space:
            raise ValueError("pieces that go across words are not supported")
        self.inner = None
        if not line:
            return r" *[^ ]+| +"
        # punctuation that no piece has after a Latin letter
        letters = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
        after = re.compile(f"[{letters}]([^{letters}])")
        crossed = {m for t in texts for m in after.findall(t)}
        marks = re.escape("".join(c for c in string.punctuation if c not in crossed))
        self.inner = re.compile(f"(?<=[{letters}])(?=[{marks}])") if marks else None
        return r"\n| *[^ \n]+| +"

    def _surface(self, i: int) -> bytes:
        kind, p = self.kinds[i], self.pieces[i]
        if kind == BYTE:
            return bytes([int(p[1:-1], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return p.replace(MARK, " ").encode()

    # -- encoding ------------------------------------------------------------------------

    def _lattice(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of every span, end to end, and their numbers. All spans advance together."""
        n = len(spans)
        size = np.fromiter(map(len, spans), np.int64, n)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        width = int(size[0]) if n else 0
        text = np.zeros((n, width + 1), np.uint8)
        joined = np.frombuffer(b"".join(spans[i] for i in order), np.uint8)
        text[np.repeat(np.arange(n), size), ranges(np.zeros(n, np.int64), size)] = joined
        best = np.full((n, width + 1), _NEG)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        starts = (text & 0xC0) != 0x80
        lead = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        alive = np.searchsorted(-size, -np.arange(width + 1), side="left")  # spans longer than each position
        for at in range(width):
            rows = np.flatnonzero(starts[: alive[at], at])
            if not len(rows):
                continue
            here = best[rows, at]
            state = np.zeros(len(rows), np.int32)
            live, one_char = np.arange(len(rows)), np.zeros(len(rows), bool)
            for depth in range(min(self.longest, width - at)):
                pos = at + depth
                live = live[size[rows[live]] > pos]
                if not len(live):
                    break
                to = self.trie.step(state[live], text[rows[live], pos])
                live = live[to >= 0]
                if not len(live):
                    break
                state[live] = to[to >= 0]
                ids = self.trie.value[state[live]]
                hit = ids >= 0
                if hit.any():
                    who, ids = live[hit], ids[hit]
                    r = rows[who]
                    total = here[who] + self.score[ids]
                    better = total > best[r, pos + 1]
                    rb = r[better]
                    best[rb, pos + 1] = total[better]
                    back[rb, pos + 1] = at
                    piece[rb, pos + 1] = ids[better]
                    one_char[who[lead[r, at] == depth + 1]] = True
            lone = np.flatnonzero(~one_char)
            if len(lone):
                r = rows[lone]
                end = np.minimum(at + lead[r, at], size[r])
                total = here[lone] + self.fallback
                better = total > best[r, end]
                best[r[better], end[better]] = total[better]
                back[r[better], end[better]] = at
                piece[r[better], end[better]] = -1
        # walk back; an uncovered character gives one piece for each of its bytes
        out_row, out_pos, out_id = [], [], []
        rows, pos = np.arange(n)[size > 0], size[size > 0].copy()
        while len(rows):
            prev, p = back[rows, pos], piece[rows, pos]
            fall = p < 0
            out_row.append(rows[~fall]), out_pos.append(prev[~fall]), out_id.append(p[~fall])
            if fall.any():
                fr, fs, fl = rows[fall], prev[fall].astype(np.int64), (pos[fall] - prev[fall])
                where = ranges(fs, fl)
                who = np.repeat(fr, fl)
                out_row.append(who), out_pos.append(where), out_id.append(self.byte_id[text[who, where]])
            going = prev > 0
            rows, pos = rows[going], prev[going].astype(np.int64)
        row = np.concatenate(out_row) if out_row else np.zeros(0, np.int64)
        where = np.concatenate(out_pos) if out_pos else np.zeros(0, np.int64)
        ids = np.concatenate(out_id) if out_id else np.zeros(0, np.int32)
        row = order[row]
        sort = np.lexsort((where, row))
        return ids[sort].astype(np.int32), np.bincount(row, minlength=n).astype(np.int64)

    def _single(self, span: bytes) -> np.ndarray:
        """The same for one long span, in memory that grows with its length alone."""
        n = len(span)
        best, back, piece = [_NEG] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        at = 0
        while at < n:
            c = span[at]
            width = min(n - at, 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            here, s, one = best[at], 0, False
            for pos in range(at, min(n, at + self.longest)):
                t = int(base[s]) + span[pos]
                if check[t] != s:
                    break
                s = t
                i = int(value[s])
                if i >= 0:
                    one |= pos + 1 == at + width
                    total = here + float(score[i])
                    if total > best[pos + 1]:
                        best[pos + 1], back[pos + 1], piece[pos + 1] = total, at, i
            if not one and here + self.fallback > best[at + width]:
                best[at + width], back[at + width], piece[at + width] = here + self.fallback, at, -1
            at += width
        out: list[int] = []
        pos = n
        while pos > 0:
            prev = back[pos]
            if piece[pos] >= 0:
                out.append(piece[pos])
            else:
                out.extend(int(self.byte_id[c]) for c in reversed(span[prev:pos]))
            pos = prev
        return np.array(out[::-1], np.int32)

    def _segment(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best pieces of spans that no piece leaves."""
        raw = [s.replace(" ", MARK).encode("utf-8", "replace") for s in spans]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(size, kind="stable")
        made: list[np.ndarray | None] = [None] * len(raw)
        at = 0
        while at < len(order):
            wide = int(size[order[at]])
            if wide > 256:
                made[order[at]] = self._single(raw[order[at]])
                at += 1
                continue
            # spans of like length, so that the lattice has few empty cells
            end = int(np.searchsorted(size[order], min(256, max(wide * 3 // 2, wide + 4)), side="right"))
            end = min(end, at + 50_000)
            group = order[at:end]
            ids, count = self._lattice([raw[i] for i in group])
            for i, part in zip(group, np.split(ids, np.cumsum(count)[:-1])):
                made[i] = part
            at = end
        length = np.fromiter(map(len, made), np.int64, len(made))
        return np.concatenate(made), length, np.zeros(len(made), bool)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of whole words, each with the marker in front: its spans' ids, end to end."""
        spans: list[str] = []
        counts = np.zeros(len(words), np.int64)
        for k, w in enumerate(words):
            found = self.split.findall(" " + w)
            if self.inner and not w.isalpha():
                found = [part for f in found for part in self.inner.split(f)]
            counts[k] = len(found)
            spans += found
        ids, length = self.parts.gather(self.parts.codes(spans))
        return ids, per_group(length, counts), np.zeros(len(words), bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has. The empty text has none."""
        for cache in (self.parts, self.words):
            if len(cache.known) > cache.most:
                cache.reset()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if not t:
                continue
            if MARK in t:
                t = t.replace(MARK, " ")
            # a run of spaces may be one piece, so a word takes all the spaces before it but one along
            found = t.split(" ") if "  " not in t and t[0] != " " and t[-1] != " " else [w[1:] for w in _SPACED.findall(" " + t)]
            counts[k] = len(found)
            words += found
        ids, length = self.words.gather(self.words.codes(words))
        return ids, per_group(length, counts)

    # -- decoding ------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Texts (binary, UTF-8) of id lists laid end to end: bytes join, markers become spaces and the
        one in front goes."""
        parts = self.surface.take(pa.array(ids, pa.int32()))
        joined = pc.binary_join(list_array(parts, lengths), b"")
        first = self.leads[ids[np.minimum(np.cumsum(lengths) - lengths, max(0, len(ids) - 1))]] if len(ids) else np.zeros(len(lengths), bool)
        lead = pa.array(first & (lengths > 0))
        return pc.if_else(lead, pc.binary_replace_slice(joined, 0, 1, b""), joined)


@lru_cache(maxsize=4)
def model(path: str) -> Unigram:
    return Unigram(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())])


def _tokens(path: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(path)
        for batch in chunks(batches, 1, chunk_bytes):
            text = batch.column(1)
            texts = strings(text)
            ids, lengths = sp.encode(texts)
            back = sp.decode(ids, lengths)
            same = pc.equal(back, pc.fill_null(text.cast(pa.binary()), b""))
            nulls = np.asarray(pc.is_null(text))
            lists = list_array(pa.array(ids, pa.int32()), lengths)
            if nulls.any():
                lists = pc.if_else(pa.array(nulls), pa.scalar(None, lists.type), lists)
                same = pc.if_else(pa.array(nulls), pa.scalar(None, pa.bool_()), same)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(lengths), same], ["doc_id", "token_ids", "n_tokens", "round_trip"])
            del lists, ids, back, texts
            release()
        # the worker goes on to other tasks, perhaps of other stages: it keeps the model but not the spans
        sp.parts.reset(), sp.words.reset()
        release()

    return run


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) of every row: the best pieces of its whole text, and
    whether decoding them gives the very text again.

    A null text gives null token_ids and round_trip with n_tokens 0; the empty text an empty list.
    Equal sums of scores are settled by the longer last piece, so results never vary. Repeated
    rows, and rows with a null id, are encoded each; an empty table gives none. Other columns play no part. A text that has
    the marker character itself decodes with a space in its place: round_trip is then false. White space becomes the marker one for one and a
    marker is put first, whatever the normaliser settings in the model file say; so texts decode to what they were.
    """
    own = spread(narrow(docs, doc_id=id_col, text=text_col))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_tokens(model_path, chunk_bytes), f"doc_id {kind}, token_ids array<int>, n_tokens bigint, round_trip boolean")


def decode(tokens: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) of id lists; a null list gives a null text, an empty one the empty text. Bytes that form no UTF-8 become U+FFFD. Repeated
    rows and null ids are decoded each; an empty table gives none; other columns play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(model_path)
        for b in batches:
            col = b.column(1)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
            back = sp.decode(np.asarray(col.flatten()).astype(np.int32), lengths)
            texts = [None if null else t.decode("utf-8", "replace") for null, t in zip(pc.is_null(col).to_pylist(), back.to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    own = narrow(tokens, doc_id=id_col, token_ids=ids_col)
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
