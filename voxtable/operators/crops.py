"""Training crops: slices in three orientations, z-stretch, sampling and clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..joins import spread_join
from ..schemas import KEYS, ZYX
from ..session import is_empty, materialize
from .masks import unit_hash

CROP = ("orientation", "slice_idx", "crop_no")
MIN_OBJECT_PX = 9  # fixed value: smaller objects are dropped from a crop


def _out_size(n: Column, anisotropy: Column) -> Column:
    return F.bround(n * anisotropy).cast("int")


def _ratio(n: Column, m: Column) -> Column:
    """Output steps per input step: (m - 1) / (n - 1)."""
    return F.when((n > 1) & (m > 1), (m - 1) / (n - 1)).otherwise(F.lit(1.0))


def stretch_z(rows: DataFrame, order: int, value: str, by: Sequence[str]) -> DataFrame:
    """Resample rows along z by ``anisotropy``; needs nz and anisotropy columns.

    Output index i reads source i (n-1)/(m-1). Order 0 takes the nearest source
    slice (label images), order 1 blends the two around it. Each source voxel
    lists the outputs it feeds.
    """
    by = list(by)
    n = F.col("nz")
    r = rows.withColumn("_m", _out_size(n, F.col("anisotropy"))).withColumn("_r", _ratio(n, F.col("_m")))
    reach = 0.5 if order == 0 else 1.0
    if order == 0:
        lo, hi = F.ceil((F.col("z") - reach) * F.col("_r")), F.ceil((F.col("z") + reach) * F.col("_r")) - 1
    else:
        lo, hi = F.floor((F.col("z") - reach) * F.col("_r")) + 1, F.ceil((F.col("z") + reach) * F.col("_r")) - 1
    r = r.withColumn("_lo", F.greatest(lo, F.lit(0))).withColumn("_hi", F.least(hi, F.col("_m") - 1)).filter("_lo <= _hi")
    r = r.withColumn("_i", F.explode(F.expr("sequence(cast(_lo AS int), cast(_hi AS int))")))
    if order == 0:
        return r.select(*by, F.col("_i").alias("z"), value)
    w = 1.0 - F.abs(F.col("_i") / F.col("_r") - F.col("z"))
    return r.groupBy(*by, F.col("_i").alias("z")).agg(F.sum(F.col(value) * w).alias(value))


def label_slices(labels: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All xy, xz and yz label slices; xz and yz are stretched along z. Columns: orientation, slice_idx, y, x, label."""
    keys = list(keys)
    dims = volumes.select(*keys, "nz", "anisotropy").distinct()
    xy = labels.select(*keys, F.lit("xy").alias("orientation"), F.col("z").alias("slice_idx"), "y", "x", "label")
    tall = spread_join(labels, dims, keys, ZYX)
    tall = stretch_z(tall, 0, "label", [*keys, "y", "x"])
    xz = tall.select(*keys, F.lit("xz").alias("orientation"), F.col("y").alias("slice_idx"), F.col("z").alias("y"), "x", "label")
    yz = tall.select(
        *keys, F.lit("yz").alias("orientation"), F.col("x").alias("slice_idx"), F.col("z").alias("y"), F.col("y").alias("x"), "label"
    )
    return xy.unionByName(xz).unionByName(yz)


def image_slices(voxels: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Image values of all xy, xz and yz slices; xz and yz are blended along z. Values are cut to whole numbers."""
    keys = list(keys)
    dims = volumes.select(*keys, "nz", "anisotropy").distinct()
    xy = voxels.select(*keys, F.lit("xy").alias("orientation"), F.col("z").alias("slice_idx"), "y", "x", "value")
    tall = stretch_z(spread_join(voxels, dims, keys, ZYX), 1, "value", [*keys, "y", "x"])
    xz = tall.select(*keys, F.lit("xz").alias("orientation"), F.col("y").alias("slice_idx"), F.col("z").alias("y"), "x", "value")
    yz = tall.select(
        *keys, F.lit("yz").alias("orientation"), F.col("x").alias("slice_idx"), F.col("z").alias("y"), F.col("y").alias("x"), "value"
    )
    return xy.unionByName(xz).unionByName(yz).withColumn("value", F.floor("value").cast("int")).filter("value <> 0")


def slice_shapes(volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Height and width of the slices per orientation."""
    tall = _out_size(F.col("nz"), F.col("anisotropy"))
    shapes = F.array(
        F.struct(F.lit("xy").alias("orientation"), F.col("ny").alias("h"), F.col("nx").alias("w")),
        F.struct(F.lit("xz").alias("orientation"), tall.alias("h"), F.col("nx").alias("w")),
        F.struct(F.lit("yz").alias("orientation"), tall.alias("h"), F.col("ny").alias("w")),
    )
    return volumes.select(*keys, F.explode(shapes).alias("_s")).select(*keys, "_s.*").distinct()


def sample_crops(
    slices: DataFrame,
    shapes: DataFrame,
    crop_size: int = 512,
    per_slice: int = 5,
    per_orientation: int = 320,
    min_px: int = 10,
    seed: int = 42,
    keys: Sequence[str] = KEYS,
    tries: int = 30,
) -> DataFrame:
    """Crop corners (top, left) anchored on labelled pixels, distinct per slice, with enough labelled pixels.

    Draws are hashes of the pixel, so a retried task repeats them. Slices
    smaller than the crop give none. The first ``per_slice * tries`` draws are
    looked at, and twice as many each time in slices that still lack crops.
    """
    keys = list(keys)
    side = [*keys, "orientation", "slice_idx"]
    px = spread_join(slices, shapes, [*keys, "orientation"], ["slice_idx", "y", "x"]).filter((F.col("h") >= crop_size) & (F.col("w") >= crop_size))
    draw = W.partitionBy(*side).orderBy(F.xxhash64(F.lit(seed), *keys, "orientation", "slice_idx", "y", "x"), "y", "x")
    anchors = px.withColumn("_n", F.row_number().over(draw))

    def corner(c: str, size: str, s: int) -> Column:
        off = F.floor(unit_hash(seed + s, *keys, "orientation", "slice_idx", "y", "x") * crop_size)
        return F.greatest(F.least(F.col(c) - off, F.col(size) - crop_size), F.lit(0)).cast("int")

    spots = anchors.select(*side, "_n", corner("y", "h", 1).alias("top"), corner("x", "w", 2).alias("left"))
    spots = materialize(spots.groupBy(*side, "top", "left").agg(F.min("_n").alias("_n")), "spots")
    good, upto = None, per_slice * tries
    while True:
        inside = spots.filter(F.col("_n") <= upto).join(slices, side).filter(
            (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + crop_size)
            & (F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + crop_size)
        )
        found = inside.groupBy(*side, "top", "left", "_n").agg(F.count("*").alias("gt_px")).filter(F.col("gt_px") >= min_px)
        found = materialize(found, "crops")
        good = found if good is None else good.unionByName(found)
        full = good.groupBy(*side).agg(F.count("*").alias("_have")).filter(F.col("_have") >= per_slice)
        spots = materialize(spots.filter(F.col("_n") > upto).join(full, side, "left_anti"), "spots")
        if is_empty(spots):
            return cap_crops(good, per_slice, per_orientation, seed, keys)
        upto *= 2


def cap_crops(spots: DataFrame, per_slice: int = 5, per_orientation: int = 320, seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """First ``per_slice`` draws of a slice, then at most ``per_orientation`` in shuffled slice order."""
    keys = list(keys)
    side = [*keys, "orientation", "slice_idx"]
    rank = F.row_number().over(W.partitionBy(*side).orderBy("_n", "top", "left"))
    kept = spots.withColumn("crop_no", rank - 1).filter(F.col("crop_no") < per_slice)
    order = W.partitionBy(*keys, "orientation").orderBy(
        F.xxhash64(F.lit(seed), *keys, "orientation", "slice_idx"), "slice_idx", "crop_no"
    )
    kept = kept.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_orientation)
    return kept.select(*side, "crop_no", "top", "left", "gt_px")


def cut_crops(slices: DataFrame, crops: DataFrame, crop_size: int, keys: Sequence[str] = KEYS, value: str = "label") -> DataFrame:
    """Pixels of each crop in crop coordinates. A slice has few crops, so the match is a slice-wise interval join."""
    keys = list(keys)
    both = slices.join(crops, [*keys, "orientation", "slice_idx"])
    both = both.withColumn("y", F.col("y") - F.col("top")).withColumn("x", F.col("x") - F.col("left"))
    both = both.filter((F.col("y") >= 0) & (F.col("y") < crop_size) & (F.col("x") >= 0) & (F.col("x") < crop_size))
    return both.select(*keys, *CROP, "y", "x", value)


def clean_truncation(crop_px: DataFrame, slices: DataFrame, threshold: float = 0.9, keys: Sequence[str] = KEYS):
    """Drop labels whose visible part is below ``threshold`` of the full slice. Returns (pixels, summary)."""
    keys = list(keys)
    seen = crop_px.filter("label > 0").groupBy(*keys, *CROP, "label").agg(F.count("*").alias("visible"))
    true = slices.groupBy(*keys, "orientation", "slice_idx", "label").agg(F.count("*").alias("true_count"))
    cut = seen.join(true, [*keys, "orientation", "slice_idx", "label"], "left").withColumn(
        "cut", F.coalesce(F.col("visible") < F.col("true_count") * threshold, F.lit(False))
    )
    kept = crop_px.join(cut.filter("cut"), [*keys, *CROP, "label"], "left_anti")
    per_crop = cut.groupBy(*keys, *CROP).agg(F.sum(F.col("cut").cast("int")).alias("n"))
    summary = per_crop.groupBy(*keys).agg(
        F.count("*").alias("n_scanned"), F.sum((F.col("n") > 0).cast("int")).alias("n_modified"), F.sum("n").alias("n_zeroed")
    )
    return kept, summary


def clean_crops(crop_px: DataFrame, min_px: int = MIN_OBJECT_PX, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop objects under ``min_px`` pixels in a crop and renumber the rest 1..N per crop."""
    keys = list(keys)
    big = crop_px.filter("label > 0").groupBy(*keys, *CROP, "label").count().filter(F.col("count") >= min_px)
    # Labels of one crop are bounded by its pixels.
    ids = big.withColumn("new_label", F.row_number().over(W.partitionBy(*keys, *CROP).orderBy("label")))
    return crop_px.join(ids.drop("count"), [*keys, *CROP, "label"]).select(
        *keys, *CROP, "y", "x", F.col("new_label").alias("label")
    )


def valid_crops(images: DataFrame, masks: DataFrame, keys: Sequence[str] = ("stem",)) -> DataFrame:
    """Images that have a mask partner and are 2-D (``ndim`` after squeezing) on both sides."""
    good = masks.filter("ndim = 2").select(*keys)
    return images.filter("ndim = 2").join(good, list(keys), "left_semi")


def bbox_crop(
    rows: DataFrame, objs: DataFrame, volumes: DataFrame, pad_z: int = 15, pad_xy: int = 40, keys: Sequence[str] = KEYS, cell: int = 64
) -> DataFrame:
    """Voxel rows inside each object's padded box, tagged ``cell_label``.

    Boxes are listed in the grid cells they cover and met by cell, so voxels are
    not compared with boxes far away.
    """
    keys = list(keys)
    dims = volumes.select(*keys, "nz", "ny", "nx").distinct()
    b = objs.join(dims, keys)
    for c, pad in zip(ZYX, (pad_z, pad_xy, pad_xy)):
        b = b.withColumn(f"{c}0", F.greatest(F.col(f"{c}0") - pad, F.lit(0))).withColumn(
            f"{c}1", F.least(F.col(f"{c}1") + pad, F.col(f"n{c}"))
        )
        b = b.withColumn(f"_g{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / cell), F.floor((F.col(f"{c}1") - 1) / cell))))
    b = b.select(*keys, F.col("label").alias("cell_label"), *[f"{c}{e}" for c in ZYX for e in "01"], *[f"_g{c}" for c in ZYX])
    v = rows
    for c in ZYX:
        v = v.withColumn(f"_g{c}", F.floor(F.col(c) / cell))
    out = v.join(b, [*keys, *[f"_g{c}" for c in ZYX]])
    for c in ZYX:
        out = out.filter(f"{c} >= {c}0 and {c} < {c}1")
    return out.drop(*[f"_g{c}" for c in ZYX])
