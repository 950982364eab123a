"""Mixing sources to target weights by weighted fair queueing.

Within its source each document, in a shuffled order, gets a virtual finish time:
the source's tokens so far divided by the source's target weight. All documents are
range-sorted by finish time and the mixture is cut at a total token budget.

Both running sums are computed as distributed prefix sums over range partitions
(per-range totals, then offsets), so neither a hot source nor the global order ever
passes through one task. Only (id, source, tokens, shuffle key) rows move.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, fresh, narrow, stage, table, word_count

#: Target weights of the production mixture; any other source has the default weight.
WEIGHTS: dict[str, float] = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
DEFAULT_WEIGHT = 1.0
BUDGET_FRACTION = 0.8
SEED = "mix-1"


def _weight(source: Column, weights: Mapping[str, float], default: float) -> Column:
    if default <= 0 or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    pick = F.lit(float(default))
    for name, w in weights.items():
        pick = F.when(source == F.lit(name), F.lit(float(w))).otherwise(pick)
    return pick


def _shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def prefix_sum(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` in ``order`` within ``by``; rows of equal order share one sum."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range", *by).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__range").alias("__r"),
        *[F.col(c).alias(f"__by_{c}") for c in by],
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"),
    )
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    within = Window.partitionBy("__range", *by).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumn("__within", F.sum(value).over(within))
        .join(offsets, same)
        .withColumn(out, F.col("__offset") + F.col("__within"))
        .select(*df.columns, out)
    )


def fair_order(
    docs: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    default_weight: float = DEFAULT_WEIGHT,
    budget: int | None = None,
    budget_fraction: float = BUDGET_FRACTION,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, source, n_tokens, shuffle_key, finish_time, cum_tokens) of the documents in the mixture.

    ``budget`` counts white-space tokens; without it, ``budget_fraction`` of all there are.
    A null source is a source of its own; a null or empty text has 0 tokens. Rows that repeat an id
    within a source are peers: they finish together and are taken or left together. An empty
    table gives an empty mixture. Other columns play no part.
    """
    own = narrow(docs, doc_id=id_col, source=source_col, text=text_col)
    own = own.select("doc_id", "source", word_count(F.col("text")).alias("n_tokens"), _shuffle_key(F.col("doc_id"), seed).alias("shuffle_key"))
    own = prefix_sum(own, ["source"], ["shuffle_key"], "n_tokens", "source_tokens")
    timed = own.select("doc_id", "source", "n_tokens", "shuffle_key", (F.col("source_tokens") / _weight(F.col("source"), weights, default_weight)).alias("finish_time"))
    ordered = stage(prefix_sum(timed, [], ["finish_time", "shuffle_key"], "n_tokens", "cum_tokens"), "fair-order")
    if budget is None:
        total = ordered.agg(F.sum("n_tokens")).first()[0] or 0
        budget = int(total * budget_fraction)
    return ordered.where(F.col("cum_tokens") <= F.lit(budget))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that are in the mixture, in the order of their finish times.

    A source's share is a prefix of its shuffled order, so one cut per source tells which rows
    stay: ``docs`` is filtered by a join with as many rows as there are sources, before its texts are shuffled: to their finish times, and to their
    place in the order. Nulls, empty texts, repeated rows and empty tables count as in ``fair_order``; repeated rows all stay or all go.
    """
    kept = fair_order(docs, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, **options)
    names = {n: fresh(docs, n) for n in ("key", "cut_source", "cut", "own_id", "own_source", "finish")}
    cuts = kept.groupBy("source").agg(F.max("shuffle_key").alias("cut"))
    cut = broadcast_if_small(stage(cuts.select(F.col("source").alias(names["cut_source"]), F.col("cut").alias(names["cut"])), "cuts"))
    keyed = docs.withColumn(names["key"], _shuffle_key(docs[f"`{id_col}`"], seed))
    inside = keyed.join(cut, keyed[f"`{source_col}`"].eqNullSafe(cut[cut.columns[0]]) & (keyed[names["key"]] <= cut[cut.columns[1]]))
    times = kept.groupBy(F.col("doc_id").alias(names["own_id"]), F.col("source").alias(names["own_source"])).agg(F.max("finish_time").alias(names["finish"]))
    timed = inside.join(times, inside[f"`{id_col}`"].eqNullSafe(times[names["own_id"]]) & inside[f"`{source_col}`"].eqNullSafe(times[names["own_source"]]))
    return timed.orderBy(names["finish"], names["key"]).drop(*names.values())


def shares(
    docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options
) -> DataFrame:
    """(source, n_tokens, of_tokens, share, target_share, ran_out): what each source has in the mixture, of what it has in all, against the share that
    its weight asks for. A source that ran out is in whole, so the others exceed their targets. A null source has its row; an empty table gives none."""
    kept = fair_order(docs, weights, default_weight, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    kept = kept.groupBy(F.col("source").alias("s")).agg(F.sum("n_tokens").alias("n"))
    whole = narrow(docs, source=source_col, text=text_col).groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("of_tokens"))
    own = whole.join(kept, whole["source"].eqNullSafe(kept["s"]), "left").select("source", F.coalesce("n", F.lit(0)).alias("n_tokens"), "of_tokens", _weight(F.col("source"), weights, default_weight).alias("w"))
    own = stage(own, "shares")
    return own.crossJoin(F.broadcast(own.agg(F.sum("n_tokens").alias("t"), F.sum("w").alias("v")))).select(
        "source", "n_tokens", "of_tokens", F.try_divide("n_tokens", "t").alias("share"), (F.col("w") / F.col("v")).alias("target_share"), (F.col("n_tokens") == F.col("of_tokens")).alias("ran_out")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fair_order(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "source", "n_tokens", F.round("finish_time", 4).alias("finish_time"), "cum_tokens")


_CASES = " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())
SQL = f"""
WITH own AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::BIGINT AS n_tokens,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
timed AS (
  SELECT doc_id, source, n_tokens, k,
         (sum(n_tokens) OVER (PARTITION BY source ORDER BY k RANGE UNBOUNDED PRECEDING))::DOUBLE
           / (CASE source {_CASES} ELSE {DEFAULT_WEIGHT} END)::DOUBLE AS finish_time FROM own),
ordered AS (
  SELECT *, (sum(n_tokens) OVER (ORDER BY finish_time, k RANGE UNBOUNDED PRECEDING))::BIGINT AS cum_tokens FROM timed)
SELECT doc_id, source, n_tokens, round(finish_time, 4) AS finish_time, cum_tokens FROM ordered
WHERE cum_tokens <= (SELECT floor(sum(n_tokens) * {BUDGET_FRACTION}) FROM own)
"""
