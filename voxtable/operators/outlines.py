"""Outlines on key slices: resampling, direction, interpolation along z, rasterising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..bricks import WORD, from_words
from ..joins import spread_by, with_sample
from ..schemas import KEYS

N_POINTS = 96  # fixed value: points per resampled outline
PROPAGATE_FROM = 90  # fixed value: slice whose outline may stand for all later ones


def arc_length(polygons: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per side of the closed outline: start, end, length and arc length at the start."""
    keys = list(keys)
    first, last = F.col("pts")[0], F.element_at("pts", -1)

    def close(c: str) -> Column:
        a, b = first[c], last[c]
        return F.abs(a - b) <= F.lit(1e-8) + F.abs(b) * 1e-5

    ring = F.when(close("y") & close("x"), F.col("pts")).otherwise(F.concat("pts", F.array(first)))
    p = polygons.select(*keys, "z", F.posexplode(ring).alias("i", "_p")).select(*keys, "z", "i", "_p.y", "_p.x")
    order = W.partitionBy(*keys, "z").orderBy("i")  # one hand-drawn outline
    p = p.withColumn("y1", F.lead("y").over(order)).withColumn("x1", F.lead("x").over(order)).filter("y1 is not null")
    step = F.sqrt((F.col("y1") - F.col("y")) ** 2 + (F.col("x1") - F.col("x")) ** 2)
    p = p.withColumn("len", step)
    return p.withColumn("start", F.sum("len").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("len"))


def resample_outline(polygons: DataFrame, n: int = N_POINTS, keys: Sequence[str] = KEYS) -> DataFrame:
    """n points at equal arc steps, the first point kept. Outlines under 3 points are dropped.

    Few points become many here, so rows go to their sample's task before and not after.
    """
    keys = list(keys)
    sides = arc_length(spread_by(polygons.filter(F.size("pts") >= 3), keys), keys)
    order = W.partitionBy(*keys, "z").orderBy("i")
    sides = sides.withColumn("_cum", F.sum("len").over(order.rowsBetween(W.unboundedPreceding, 0)))
    sides = sides.withColumn("_from", F.coalesce(F.lag("_cum").over(order), F.lit(0.0)))
    sides = sides.withColumn("_total", F.max("_cum").over(W.partitionBy(*keys, "z")))
    # Sample k lies at total * k / n; a side lists the samples that fall on it.
    first = F.ceil(F.col("_from") * n / F.col("_total"))
    stop = F.ceil(F.col("_cum") * n / F.col("_total"))
    sides = sides.withColumn("_a", first).withColumn("_b", F.least(stop, F.lit(n))).filter("_b > _a")
    # Outlines are gathered and sorted as sides; their many points come last, so that nothing sorts or keeps those.
    side = F.struct("i", *[F.col(c).cast("int").alias(c) for c in ("_a", "_b")], "y", "x", "y1", "x1", "_from", "len", "_total")
    whole = sides.groupBy(*keys, "z").agg(F.array_sort(F.collect_list(side)).alias("_sides")).sortWithinPartitions(*keys, "z")

    def points(s: Column) -> Column:
        def point(k: Column) -> Column:
            t = (s["_total"] * k / n - s["_from"]) / s["len"]
            return F.struct(*[(s[c] + (s[f"{c}1"] - s[c]) * t).alias(c) for c in "yx"])

        return F.transform(F.sequence(s["_a"], s["_b"] - 1), point)

    return whole.select(*keys, "z", F.flatten(F.transform("_sides", points)).alias("pts"))


def shoelace(pts: str = "pts") -> Column:
    """Sum of x_i y_(i-1) - y_i x_(i-1), the first point wrapping to the last."""
    p = F.col(pts)
    before = F.concat(F.slice(p, -1, 1), F.slice(p, F.lit(1), F.size(p) - 1))
    terms = F.zip_with(p, before, lambda a, b: a["x"] * b["y"] - a["y"] * b["x"])
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def align_direction(polygons: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Reverse outlines that turn the other way than the sample's first key slice."""
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy("z")  # at most one row per slice of a sample
    p = polygons.withColumn("_cw", shoelace() < 0)
    p = p.withColumn("_ref", F.first("_cw").over(order.rowsBetween(W.unboundedPreceding, 0)))
    pts = F.when(F.col("_cw") == F.col("_ref"), F.col("pts")).otherwise(F.reverse("pts"))
    return p.select(*keys, "z", pts.alias("pts"), (F.col("_cw") != F.col("_ref")).alias("reversed"))


def lerp_outline(p1: str, p2: str, alpha: Column) -> Column:
    return F.zip_with(
        p1,
        p2,
        lambda a, b: F.struct(
            ((1 - alpha) * a["y"] + alpha * b["y"]).alias("y"), ((1 - alpha) * a["x"] + alpha * b["x"]).alias("x")
        ),
    )


def bracket_slices(key_slices: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """For every slice the key slice at or below (z_low) and at or above (z_high); null past the ends.

    Each key slice lists the slices up to the next one, so the as-of match needs no join.
    """
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy("z")  # at most one row per slice of a sample
    k = key_slices.select(*keys, "z").distinct().join(volumes.select(*keys, "nz").distinct(), keys)
    k = k.withColumn("_next", F.lead("z").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    inner = k.withColumn("s", F.explode(F.sequence("z", F.coalesce(F.col("_next") - 1, F.col("nz") - 1))))
    inner = inner.select(
        *keys, F.col("s").alias("z"), F.col("z").alias("z_low"), F.when(F.col("s") == F.col("z"), F.col("z")).otherwise(F.col("_next")).alias("z_high")
    )
    head = k.filter("_first and z > 0").withColumn("s", F.explode(F.expr("sequence(0, z - 1)")))
    head = head.select(*keys, F.col("s").alias("z"), F.lit(None).cast("int").alias("z_low"), F.col("z").alias("z_high"))
    return inner.unionByName(head)


def interpolate_outlines(
    polygons: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS, propagate_from: int | None = PROPAGATE_FROM, n: int = N_POINTS
) -> DataFrame:
    """An outline for every slice. Slices past the ends copy the nearest key outline.

    If ``propagate_from`` is a key slice of the sample, its outline stands for
    every later slice that has no outline of its own.
    """
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy("z")  # at most one row per slice of a sample
    k = align_direction(resample_outline(polygons, n, keys), keys).select(*keys, "z", "pts")
    # The outline that stands for later slices, known from its slice on.
    stay = F.when(F.col("z") == propagate_from, F.col("pts")) if propagate_from is not None else F.when(F.lit(False), F.col("pts"))
    k = k.select(
        "*", F.lead("z").over(order).alias("_next"), F.lead("pts").over(order).alias("_p2"),
        (F.row_number().over(order) == 1).alias("_first"),
        F.last(stay, True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("_stay"),
    )
    # Each outline lists its own slice and those up to the next one; the first also those before it.
    k = with_sample(k, volumes.select(*keys, "nz").distinct(), keys)
    first = F.when(F.col("_first"), F.lit(0)).otherwise(F.col("z"))
    last = F.greatest(F.coalesce(F.col("_next"), F.col("nz")) - 1, F.col("z"))
    s = k.withColumn("_s", F.explode(F.sequence(first, last))).withColumnsRenamed({"z": "_key", "_s": "z"})
    alpha = (F.col("z") - F.col("_key")) / (F.col("_next") - F.col("_key"))
    pts = (
        F.when(F.col("z") <= F.col("_key"), F.col("pts"))
        .when(F.col("_stay").isNotNull(), F.col("_stay"))
        .when(F.col("_next").isNull(), F.col("pts"))
        .otherwise(lerp_outline("pts", "_p2", alpha))
    )
    return s.filter("z < nz").select(*keys, "z", pts.alias("pts"))


def rasterize(polygons: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS, words: bool = False) -> DataFrame:
    """Sites inside each outline by the even-odd rule, row by row; with ``words`` as ``bricks.as_words`` gives them."""
    keys = list(keys)
    p = F.col("pts")
    after = F.concat(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, 1, 1))
    sides = F.arrays_zip(p.alias("a"), after.alias("b"))
    e = with_sample(polygons, volumes.select(*keys, "ny", "nx").distinct(), keys).select(
        *keys, "z", "ny", "nx", F.explode(sides).alias("_s")
    )
    e = e.select(
        *keys, "z", "ny", "nx", *[F.col(f"_s.{s}.{c}").alias(f"{c}{i}") for i, s in enumerate("ab") for c in "yx"]
    ).filter("y0 <> y1")
    lo, hi = F.greatest(F.ceil(F.least("y0", "y1")), F.lit(0)), F.least(F.ceil(F.greatest("y0", "y1")) - 1, F.col("ny") - 1)
    e = e.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi").withColumn("y", F.explode(F.expr("sequence(_lo, _hi)")))
    cross = F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    # A crossing flips every site before it, so a site is set if an odd number of crossings lie beyond it.
    rows = e.select(*keys, "z", F.col("y").cast("int"), F.least(F.ceil(cross), F.col("nx")).cast("int").alias("_stop")).filter("_stop > 0")
    rows = rows.withColumn("w", F.explode(F.expr(f"sequence(0, CAST((_stop - 1) DIV {WORD} AS INT))")))
    one, n = F.lit(1).cast("long"), F.least(F.col("_stop") - F.col("w") * WORD, F.lit(WORD))
    before = F.call_function("shiftleft", one, n) - one
    out = rows.groupBy(*keys, "z", "y", "w").agg(F.bit_xor(before).alias("bits")).filter("bits <> 0")
    return out if words else from_words(out, keys)
