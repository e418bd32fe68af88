"""Regions cut by boundary lines: side of and distance to each line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..joins import spread_join
from ..schemas import KEYS


def segments(boundaries: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per line segment: line_no, seq, (ay, ax) -> (by, bx)."""
    order = W.partitionBy(*keys, "line_no").orderBy("seq")  # one drawn line
    s = boundaries.select(
        *keys, "line_no", "seq", F.col("y_um").alias("ay"), F.col("x_um").alias("ax"),
        F.lead("y_um").over(order).alias("by"), F.lead("x_um").over(order).alias("bx"),
    )
    return s.filter("by is not null")


def polyline_side_dist(points: DataFrame, boundaries: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per point (label, y, x) and line: distance to the line and side at its nearest segment.

    Side is -1 where the cross product is negative. Of equally near segments the
    first counts. The lines of a sample are a handful of drawn curves, carried
    to its points as one array, so points are never repeated through a join.
    """
    keys = list(keys)
    seg = F.struct("line_no", "seq", "ay", "ax", "by", "bx")
    lines = segments(boundaries, keys).groupBy(*keys).agg(F.collect_list(seg).alias("_segs"))
    p = spread_join(points.select(*keys, "label", "y", "x"), lines, keys, ["label"])
    p = p.select(*keys, "label", "y", "x", F.explode("_segs").alias("_s")).select(*keys, "label", "y", "x", "_s.*")
    dy, dx = F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")
    den = dx * dx + dy * dy
    along = ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / den
    t = F.when(den < 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))
    py, px = F.col("ay") + t * dy, F.col("ax") + t * dx
    dist = F.sqrt((F.col("x") - px) ** 2 + (F.col("y") - py) ** 2)
    cross = dx * (F.col("y") - F.col("ay")) - dy * (F.col("x") - F.col("ax"))
    p = p.withColumn("dist", dist).withColumn("side", F.when(cross < 0, -1).otherwise(1))
    return p.groupBy(*keys, "label", "line_no").agg(
        F.min("dist").alias("dist"), F.min_by("side", F.struct("dist", "seq")).alias("side")
    )


def assign_regions(points: DataFrame, boundaries: DataFrame, names: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Region = name at the number of lines a point lies to the right of; plus its distance to the nearest line.

    Missing names read ``region_i``. Samples without lines get '' and 0.
    """
    keys = list(keys)
    sides = polyline_side_dist(points, boundaries, keys)
    r = sides.groupBy(*keys, "label").agg(
        F.sum((F.col("side") < 0).cast("int")).cast("int").alias("_i"), F.min("dist").alias("region_boundary_dist_um")
    )
    out = points.select(*keys, "label").join(r, [*keys, "label"], "left")
    default = F.concat(F.lit("region_"), F.col("_i").cast("string"))
    if names is not None:
        out = out.join(names.select(*keys, "names"), keys, "left")
        named = F.when(F.col("_i") < F.coalesce(F.size("names"), F.lit(0)), F.expr("names[_i]"))
        region = F.coalesce(named, default, F.lit(""))
    else:
        region = F.coalesce(default, F.lit(""))
    return out.select(
        *keys, "label", region.alias("brain_region"), F.coalesce("region_boundary_dist_um", F.lit(0.0)).alias("region_boundary_dist_um")
    )
