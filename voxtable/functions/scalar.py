"""Column expressions for derived per-object values. Rounding is half-even."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..joins import spread_join
from ..schemas import KEYS, ZYX

GAMMA_4_3 = 0.8929795115692493  # fixed value: Gamma(4/3)


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def anisotropy(sz, sy, sx) -> Column:
    """z step over the mean in-plane step; 1 when that mean is not positive."""
    xy = (_c(sx) + _c(sy)) / 2.0
    return F.when(xy > 0, _c(sz) / xy).otherwise(F.lit(1.0))


def eq_diam(volume_um3) -> Column:
    return F.cbrt(_c(volume_um3) * 6.0 / math.pi)


def sphericity(volume_um3, area) -> Column:
    s = F.lit(math.pi ** (1 / 3)) * F.pow(_c(volume_um3) * 6.0, F.lit(2.0 / 3.0)) / _c(area)
    return F.when(_c(area) > 0, F.least(s, F.lit(1.0))).otherwise(F.lit(0.0))


def per_volume(x, volume, factor: float = 1.0, digits: int = 4) -> Column:
    return F.when(_c(volume) > 0, F.bround(_c(x) / _c(volume) * factor, digits)).otherwise(F.lit(0.0))


def branch_ratios(objs: DataFrame) -> DataFrame:
    """surface_to_volume_ratio, branch and endpoint density, process complexity."""
    v = "_vol" if "_vol" in objs.columns else "volume_um3"
    return objs.withColumns(
        {
            "surface_to_volume_ratio": per_volume("surface_area_um2", v),
            "branch_density": per_volume("n_branches", v, 1e6),
            "endpoint_density": per_volume("n_endpoints", v, 1e6),
            "process_complexity": per_volume(F.col("n_endpoints") * F.col("mean_branch_len_um"), v, 1.0, 6),
        }
    )


def morphotype(spher, solid, elong, n_br, sav) -> Column:
    spher, solid, elong, n_br, sav = map(_c, (spher, solid, elong, n_br, sav))
    return (
        F.when((elong > 3.5) & (n_br <= 3), "Rod-shaped")
        .when((spher > 0.70) & (solid > 0.80) & (n_br <= 2), "Amoeboid")
        .when((n_br >= 6) & (sav > 2.0) & (spher < 0.55), "Ramified")
        .when((n_br >= 4) & (spher < 0.65), "Intermediate-ramified")
        .otherwise("Intermediate")
    )


def dice_of(iou) -> Column:
    return _c(iou) * 2.0 / (_c(iou) + 1.0)


def size_delta(pred, gt) -> Column:
    return F.when(_c(pred) > 0, (_c(pred) - _c(gt)) / _c(gt) * 100.0).otherwise(F.lit(-100.0))


def to_um(objs: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Physical sizes of ``object_info`` rows: volume_um3, centroids and box sides, rounded to 2 decimals."""
    o = spread_join(objs, volumes.select(*keys, "sz", "sy", "sx").distinct(), keys, ["label"])
    vol = F.col("volume_vox") * (F.col("sz") * F.col("sy") * F.col("sx"))
    cols = {"_vol": vol, "volume_um3": F.bround(vol, 2)}
    for c in ZYX:
        cols[f"centroid_{c}_vox"] = F.bround(F.col(f"c{c}"), 2)
        cols[f"centroid_{c}_um"] = F.bround(F.col(f"c{c}") * F.col(f"s{c}"), 2)
        cols[f"bbox_d{c}_um"] = F.bround((F.col(f"{c}1") - F.col(f"{c}0")) * F.col(f"s{c}"), 2)
    return o.withColumns(cols)


def depth_normalized(objs: DataFrame, z: str = "centroid_z_um", keys: Sequence[str] = KEYS) -> DataFrame:
    """z / max z per sample, clipped to [0, 1]; 0 when no object lies below the top."""
    top = objs.groupBy(*keys).agg(F.max(z).alias("_top"))
    d = F.when(F.col("_top") > 0, F.least(F.greatest(F.col(z) / F.col("_top"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return spread_join(objs, top, keys, ["label"]).withColumn("depth_normalized", d).drop("_top")


def clark_evans(objs: DataFrame, nnd: str = "nearest_neighbor_dist_um", keys: Sequence[str] = KEYS) -> DataFrame:
    """Nearest distance over its expectation for an even spread in the sample's bounding box."""
    at = [f"centroid_{c}_um" for c in ZYX]
    box = F.lit(1.0)
    for c in at:
        box = box * (F.max(c) - F.min(c) + 1e-10)
    e = objs.groupBy(*keys).agg(F.count("*").alias("_n"), box.alias("_box"))
    expect = F.lit(GAMMA_4_3) * F.cbrt(F.lit(3.0) / (F.lit(4.0 * math.pi) * (F.col("_n") / F.col("_box"))))
    ratio = F.when(F.col("_n") < 2, F.lit(1.0)).when(expect > 0, F.col(nnd) / expect).otherwise(F.lit(1.0))
    return spread_join(objs, e, keys, ["label"]).withColumn("nearest_neighbor_ratio", ratio).drop("_n", "_box")
