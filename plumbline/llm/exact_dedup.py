"""Exact deduplication with a heavy-hitter split.

Only (id, digest) pairs are ever shuffled, never texts. Misra-Gries summaries of each
partition are merged into a bounded candidate set; exact counts verify it; the winners
of the verified heavy digests (at most ``counters``, so of a fixed size) are broadcast
and their copies fall away before the shuffle. All other digests are grouped by an
ordinary shuffle, which no heavy digest can skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, narrow, stage


def _shrink(counts: dict, counters: int) -> dict:
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {v: c - cut for v, c in counts.items() if c > cut}


def misra_gries(values, counters: int) -> dict:
    """Summary of ``values``: each count is short by at most n / (counters + 1)."""
    counts: dict = {}
    for chunk in values:
        for v, c in chunk:
            counts[v] = counts.get(v, 0) + c
        counts = _shrink(counts, counters)
    return counts


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted():
            for b in batches:
                vc = pc.value_counts(b.column(0))
                yield zip(vc.field("values").to_pylist(), vc.field("counts").to_pylist())

        found = misra_gries(counted(), counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())}
        )

    return run


def _digest(text):
    return F.unhex(F.sha2(text, 256))


def heavy_winners(digests: DataFrame, counters: int = 1024) -> DataFrame:
    """(digest, winner, n_copies) of every digest with over 2/counters of all rows; at most ``counters`` rows."""
    rows = digests.count()
    least = max(2, 2 * rows // counters)
    merged = (
        digests.select("digest")
        .where("digest is not null")
        .mapInArrow(_summaries(counters), "digest binary, n bigint")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        # a summed count is short by at most rows / (counters + 1)
        .where(F.col("n") + rows // (counters + 1) + 1 >= least)
        .select("digest")
    )
    # true counts prove which candidates are heavy, and their smallest id is the winner
    return (
        digests.join(F.broadcast(merged), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("winner"), F.count("*").alias("n_copies"))
        .where(F.col("n_copies") >= least)
    )


def survivors(docs: DataFrame, counters: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, digest, n_copies) for each distinct text; the smallest id wins.

    Null texts are unknown, hence never copies: each such row stays, with a null digest and
    n_copies 1. The empty text is a text like any other. A null id loses against any other.
    Repeated rows count as copies. An empty table gives an empty result; other columns,
    whatever their names, play no part.
    """
    digests = stage(
        narrow(docs, doc_id=id_col, text=text_col).select("doc_id", _digest(F.col("text")).alias("digest")), "digests"
    )
    heavy = stage(heavy_winners(digests, counters), "heavy")
    known = digests.where("digest is not null")
    rest = (
        known.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("winner"), F.count("*").alias("n_copies"))
    )
    return (
        heavy.unionByName(rest)
        .select(F.col("winner").alias("doc_id"), "digest", "n_copies")
        .unionByName(digests.where("digest is null").select("doc_id", "digest", F.lit(1).cast("bigint").alias("n_copies")))
    )


def dedup(docs: DataFrame, counters: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, but only one row of each distinct text.

    Same rules as ``survivors``: null texts stay, the smallest id of equal texts wins (a null id loses against any other), of rows that repeat
    it one stays, an empty table stays empty. The rows that go are found on (id, digest) alone; ``docs``
    meets that list once in an anti join, which is broadcast if it is small.
    """
    d = fresh(docs, "digest")
    digests = stage(
        narrow(docs, doc_id=id_col, text=text_col)
        .where(F.col("text").isNotNull())
        .select("doc_id", _digest(F.col("text")).alias("digest")),
        "digests",
    )
    heavy = F.broadcast(stage(heavy_winners(digests, counters), "heavy").select("digest", "winner"))
    rest = (
        digests.join(heavy.select("digest"), "digest", "left_anti")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("winner"), F.count("*").alias("n"))
        .where("n > 1")
    )
    rest = stage(rest.select("digest", "winner"), "winners")
    # a null id in a group that has another id loses, too
    lost = lambda winners: digests.join(winners, "digest").where(~F.col("doc_id").eqNullSafe(F.col("winner"))).select("doc_id", "digest")
    losers = stage(lost(heavy).unionByName(lost(broadcast_if_small(rest))).distinct(), "losers")
    # rows that repeat the winner's own id; as a rule there are none, and nothing more is done
    again = digests.join(losers, (digests["doc_id"].eqNullSafe(losers["doc_id"])) & (digests["digest"] == losers["digest"]), "left_anti")
    again = stage(again.groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest"), "repeated")
    tagged = docs.withColumn(d, _digest(docs[f"`{text_col}`"]))

    def on(other):
        return tagged[f"`{id_col}`"].eqNullSafe(other["doc_id"]) & (tagged[d] == other["digest"])

    losers = broadcast_if_small(losers)
    kept = tagged.join(losers, on(losers), "left_anti")
    if again.isEmpty():
        return kept.drop(d)
    twice = tagged.join(again, on(again), "left_semi").dropDuplicates([id_col, d])
    return kept.join(again, kept[f"`{id_col}`"].eqNullSafe(again["doc_id"]) & (kept[d] == again["digest"]), "left_anti").unionByName(twice).drop(d)


def query(spark, sf_dir):
    return survivors(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.lower(F.hex("digest")).alias("digest"), "n_copies")


SQL = """
SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS n_copies
FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)
UNION ALL
SELECT doc_id, NULL AS digest, 1 AS n_copies FROM documents WHERE text IS NULL
"""
