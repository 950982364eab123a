"""Token ids as seekable binary shards: one zstandard frame for each document.

A shard is a row of independent zstandard frames, then a seek table in a skippable frame, as in
zstandard's seekable format: for every frame its compressed and raw size and a checksum (the low 32 bits
of XXH64 over the raw bytes), a footer with the number of frames, and a magic number at the very
end. A reader takes the table from the tail and decompresses only the frames of the documents asked for.
Ids are little-endian, of 2 bytes if the vocabulary allows, else of 4.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import importable
from .common import chunks, list_array, narrow, release, strings, table
from .spans import SpanCache, per_group

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern by which the vocabulary's texts are split before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80


class ByteBpe:
    """Byte-level BPE; each distinct word is merged once (up to ``most`` are kept at a time)."""

    def __init__(self, path: str = RANKS, most: int = 400_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = SpanCache(self._learn, self.dtype, most)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A first word is kept with a zero byte in front, any other stands after a space."""
        made = [self.bpe.encode_ordinary(w[1:] if w[:1] == "\0" else " " + w) for w in words]
        length = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), self.dtype, int(length.sum()))
        # next to other white space the space between words may belong elsewhere
        odd = np.fromiter((w in ("", "\0") or w[:1].isspace() or w[1:2].isspace() or w[-1].isspace() or w[0] == "\0" and w[1:2] == "\0" for w in words), bool, len(words))
        return flat, length, odd

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has.

        Pre-tokens never cross a single space between two words, so texts are encoded word by word; a text
        that has a space beside other white space, or zero bytes, is encoded as a whole.
        """
        if len(self.words.known) > self.words.most:
            self.words.reset()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        whole = np.zeros(len(texts), bool)
        for k, t in enumerate(texts):
            if not t:
                continue
            if "\0" in t:
                whole[k] = True
                continue
            found = t.split(" ")
            found[0] = "\0" + found[0]
            counts[k] = len(found)
            words += found
        codes = self.words.codes(words)
        whole |= per_group(self.words.flag[codes], counts) > 0
        if not whole.any():
            ids, length = self.words.gather(codes)
            return ids, per_group(length, counts)
        keep = np.repeat(~whole, counts)
        ids, length = self.words.gather(codes[keep])
        sizes = per_group(length, np.where(whole, 0, counts))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k in np.flatnonzero(whole):
            parts[k] = np.array(self.bpe.encode_ordinary(texts[k]), self.dtype)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def decode(self, ids: Iterable[int]) -> str:
        return self.bpe.decode(list(ids))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def seal(frames: list[bytes], raw_sizes: list[int], sums: list[int]) -> bytes:
    """A shard of these frames with its seek table."""
    entries = b"".join(struct.pack("<III", len(f), r, s) for f, r, s in zip(frames, raw_sizes, sums))
    footer = struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class Shard:
    """Reads single documents of a shard; ``source`` is bytes or an open binary file."""

    def __init__(self, source, dtype: str = "<u2"):
        self.source, self.dtype = source, np.dtype(dtype)
        if not isinstance(source, (bytes, memoryview)):
            source.seek(0, 2)
        self.end = len(source) if isinstance(source, (bytes, memoryview)) else source.tell()
        n, flags, magic = struct.unpack("<IBI", self._read(self.end - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table at the end")
        self.table = np.frombuffer(self._read(self.end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offset = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        if isinstance(self.source, (bytes, memoryview)):
            return bytes(self.source[at : at + n])
        self.source.seek(at)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.table)

    def __getitem__(self, frame: int) -> np.ndarray:
        size, raw, check = self.table[frame]
        data = self.unpack.decompress(self._read(int(self.offset[frame]), int(size)), max_output_size=int(raw)) if raw else b""
        if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {frame} is damaged")
        return np.frombuffer(data, self.dtype)


def _pack(path: str, level: int, shard_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        zstd = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        part, number = TaskContext.get().partitionId(), 0
        frames: list[bytes] = []
        raws: list[int] = []
        sums: list[int] = []
        ids: list[pa.Array] = []
        held = 0

        def flush():
            nonlocal number, held
            doc_ids = pa.concat_arrays(ids)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part:06d}-{number:06d}"]),
                    pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                    pa.array([np.array(raws, np.int64) // bpe.dtype.itemsize], pa.list_(pa.int64())),
                    pa.array([bpe.dtype.itemsize], pa.int32()),
                    pa.array([seal(frames, raws, sums)], pa.binary()),
                ],
                ["shard", "doc_ids", "n_tokens", "id_bytes", "data"],
            )
            frames.clear(), raws.clear(), sums.clear(), ids.clear()
            number, held = number + 1, 0
            return row

        for batch in chunks(batches, 1, chunk_bytes):
            flat, lengths = bpe.encode(strings(batch.column(1)))
            data = memoryview(flat.tobytes())
            at = 0
            for k, n in enumerate((lengths * bpe.dtype.itemsize).tolist()):
                raw = data[at : at + n]
                at += n
                frame = zstd.compress(raw)
                frames.append(frame), raws.append(n), sums.append(xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
                ids.append(batch.column(0).slice(k, 1))
                held += len(frame) + 12
                if held >= shard_bytes:
                    yield flush()
            release()
        if frames:
            yield flush()
        bpe.words.reset()  # the worker goes on to other tasks
        release()

    return run


def write_shards(
    docs: DataFrame,
    tokenizer_path: str = RANKS,
    level: int = 3,
    shard_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """(shard, doc_ids, n_tokens, id_bytes, data): every document's whole text as one frame, in input order.

    ``data`` is a shard of about ``shard_bytes``; frame k of it belongs to ``doc_ids[k]``. Nothing is
    shuffled. A null text, like the empty one, is a frame of 0 tokens. A text of any length is one
    frame. Repeated rows and null ids get frames like any others; no documents, no shards. Other columns
    play no part.
    """
    own = narrow(docs, doc_id=id_col, text=text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(
        _pack(tokenizer_path, level, shard_bytes, chunk_bytes),
        f"shard string, doc_ids array<{kind}>, n_tokens array<bigint>, id_bytes int, data binary",
    )


def read_documents(shards: DataFrame, doc_ids: DataFrame | Iterable[int] | None = None) -> DataFrame:
    """(doc_id, token_ids) of the requested documents (None: all); other frames stay compressed.

    ``doc_ids`` is a table with a doc_id column, or a few ids. Ids that no shard has, and null ids, give nothing; repeated requests count once; an id
    with several frames gives each. Where the frames are is found on the ids alone; then every shard that has one is read once.
    """
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    own = shards.select("shard", "doc_ids", "id_bytes", "data")
    if doc_ids is None:
        own = own.withColumn("frames", F.sequence(F.lit(0), F.size("doc_ids") - 1))
    else:
        spark = shards.sparkSession
        wanted = doc_ids.select(F.col("doc_id").cast(kind).alias("doc_id")) if isinstance(doc_ids, DataFrame) else spark.createDataFrame([(i,) for i in doc_ids], f"doc_id {kind}")
        places = shards.select("shard", F.posexplode("doc_ids").alias("frame", "doc_id")).join(wanted.distinct(), "doc_id")
        own = own.join(places.groupBy("shard").agg(F.array_sort(F.collect_list("frame")).alias("frames")), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                frames = np.asarray(b.column("frames")[k].values, np.int64)
                shard = Shard(memoryview(b.column("data")[k].as_buffer()), f"<u{b.column('id_bytes')[k].as_py()}")
                tokens = [shard[i].astype(np.int32) for i in frames]
                ids = b.column("doc_ids")[k].values.take(pa.array(frames))
                size = np.fromiter(map(len, tokens), np.int64, len(tokens))
                yield pa.RecordBatch.from_arrays([ids, list_array(pa.array(np.concatenate(tokens)), size)], ["doc_id", "token_ids"])

    importable(shards.sparkSession)
    return own.mapInArrow(run, f"doc_id {kind}, token_ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(table(spark, sf_dir, "documents"))
