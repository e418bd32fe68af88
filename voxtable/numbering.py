"""Ranks, running totals and exact quantiles that never gather a whole key.

A plain ``row_number().over(partitionBy(fish))`` puts a whole sample in one
task. Here rows are range-sorted over the cluster once; a rank is the position
inside the sorted partition plus the row counts of the partitions before it,
so one hot sample spreads over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .joins import spread_join
from .session import materialize


def _sorted_with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranged = df.orderBy(*[F.col(k) for k in keys], *order)
    ranged = ranged.withColumn("_pos", F.monotonically_increasing_id())
    ranged = materialize(ranged, "sorted")
    return ranged.withColumn("_part", F.shiftright("_pos", 33))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """1..N per key in ``order`` (which must leave no ties)."""
    rows = _sorted_with_position(df, keys, order)
    per_part = rows.groupBy(*keys, "_part").agg(F.min("_pos").alias("_lo"), F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per_part = per_part.select(
        *keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo") + 1).alias("_shift")
    )
    return (
        rows.join(per_part, [*keys, "_part"])
        .withColumn(name, (F.col("_pos") + F.col("_shift")).cast("int"))
        .drop("_pos", "_part", "_shift")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: str, name: str = "running"
) -> DataFrame:
    """Inclusive running sum of ``weight`` per key in ``order`` (no ties)."""
    rows = _sorted_with_position(df, keys, order)
    per_part = rows.groupBy(*keys, "_part").agg(F.sum(weight).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per_part = per_part.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("_in", F.sum(weight).over(inside))
        .join(per_part, [*keys, "_part"])
        .withColumn(name, F.col("_in") + F.col("_base"))
        .drop("_pos", "_part", "_in", "_base")
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per key: one row, one column per entry of ``probs``."""
    w = F.sum(weight) if weight else F.count("*")
    hist = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(w.cast("long").alias("_w"))
    hist = hist.filter("_w > 0")
    cum = running_total(hist, keys, [F.col("_v")], "_w", "_cum")
    totals = cum.groupBy(*keys).agg(F.max("_cum").alias("_total"))
    wanted = totals.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("q"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos"))
                    for n, p in probs.items()
                ]
            )
        ).alias("_t"),
    )
    wanted = wanted.select(*keys, F.col("_t.q").alias("_q"), F.col("_t.pos").alias("_pos"))
    # A rank r (0-based) lies on the value whose running count first exceeds r.
    hit = (F.col("_cum") > F.floor("_pos")) & (F.col("_cum") - F.col("_w") <= F.ceil("_pos"))
    bounds = (
        spread_join(cum, wanted, keys, ["_v"])
        .filter(hit)
        .groupBy(*keys, "_q", "_pos")
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    point = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))
    return bounds.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == n, point)).alias(n) for n in probs])
