"""Join of many rows with one row (or few) per sample, safe for a sample that holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

PARTS = 16  # slices a sample's rows are dealt into


def by_site(sites: DataFrame) -> DataFrame:
    """A mask or lattice as a join's second side, sorted and merged, never sent to the driver.

    Spark takes a table that ``explode`` made for the size of the few rows it was made
    from, and a regular mask for its well-packed file, and would broadcast either.
    """
    return sites.hint("merge")


def spread_by(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows dealt by ``cols`` over all shuffle partitions, for work that makes them many times larger.

    Without a number Spark would merge partitions by the few bytes they hold now.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def with_sample(rows: DataFrame, per_sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outlines of a sample, at most one per slice, with the sample's row; the outlines are neither sorted nor broadcast."""
    return rows.join(per_sample.hint("shuffle_hash"), list(keys))


def spread_join(
    rows: DataFrame, per_sample: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner", parts: int = PARTS,
    known: bool = False, keep_part: bool = False,
) -> DataFrame:
    """``rows.join(per_sample, keys)`` with the rows of each sample dealt into ``parts`` by a hash of ``by``.

    The small side is repeated once per part and hashed where its rows are, so the rows are neither
    sorted nor broadcast: regular ones pack so well that Spark would take millions for a few MB and send
    them to the driver. ``known``: ``per_sample`` is a written table, whose size lets Spark send it instead.
    ``keep_part`` leaves ``_part_no``: rows with the same ``by`` are then in one place for a grouping by keys and _part_no,
    and partitions are not merged by the few bytes such rows pack into.
    """
    keys = list(keys)
    dealt = rows.withColumn("_part_no", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    dealt = spread_by(dealt, [*keys, "_part_no"]) if keep_part else dealt
    wide = per_sample.withColumn("_part_no", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = dealt.join(wide if known else wide.hint("shuffle_hash"), [*keys, "_part_no"], how)
    return out if keep_part else out.drop("_part_no")
