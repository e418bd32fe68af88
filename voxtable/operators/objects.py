"""One row per object: size, place, shape tensor, axes, intensity, neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import KEYS, ZYX

NOISE = 1e-7  # relative error of the closed form where eigenvalues nearly coincide


def object_info(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """volume_vox, centroid and half-open bbox per label."""
    return labels.groupBy(*keys, "label").agg(
        F.count("*").alias("volume_vox"),
        *[F.avg(c).alias(f"c{c}") for c in ZYX],
        *[F.min(c).alias(f"{c}0") for c in ZYX],
        *[(F.max(c) + 1).alias(f"{c}1") for c in ZYX],
    )


def regionprops(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``object_info`` plus extent and the inertia tensor (i_zz, i_yy, i_xx, i_zy, i_zx, i_yx)."""
    p = labels.groupBy(*keys, "label").agg(
        F.count("*").alias("volume_vox"),
        *[F.avg(c).alias(f"c{c}") for c in ZYX],
        *[F.min(c).alias(f"{c}0") for c in ZYX],
        *[(F.max(c) + 1).alias(f"{c}1") for c in ZYX],
        *[F.var_pop(c).alias(f"_v{c}") for c in ZYX],
        *[F.covar_pop(a, b).alias(f"_c{a}{b}") for a, b in ("zy", "zx", "yx")],
    )
    box = (F.col("z1") - F.col("z0")).cast("long") * (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    return p.select(
        *keys,
        "label",
        "volume_vox",
        *[f"c{c}" for c in ZYX],
        *[f"{c}{e}" for e in "01" for c in ZYX],
        (F.col("volume_vox") / box).alias("extent"),
        (F.col("_vy") + F.col("_vx")).alias("i_zz"),
        (F.col("_vz") + F.col("_vx")).alias("i_yy"),
        (F.col("_vz") + F.col("_vy")).alias("i_xx"),
        *[(-F.col(f"_c{p}")).alias(f"i_{p}") for p in ("zy", "zx", "yx")],
    )


def principal_axes(props: DataFrame) -> DataFrame:
    """Eigenvalues of the inertia tensor in closed form, axis lengths and main direction.

    All in column expressions, so it stays in generated code. The direction is
    the largest component of the eigenvector of the smallest eigenvalue, read
    from the diagonal of the adjugate of (A - l3 I).
    """
    a, b, c = F.col("i_zz"), F.col("i_yy"), F.col("i_xx")
    d, e, f = F.col("i_zy"), F.col("i_zx"), F.col("i_yx")
    p = props.withColumn("_t", a + b + c).withColumn("_q", F.col("_t") / 3.0)
    q = F.col("_q")
    off = d * d + e * e + f * f
    p = p.withColumn("_p", F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + off * 2.0) / 6.0))
    s = F.col("_p")
    det = (
        (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)
    )
    flat = s <= F.col("_t") * 1e-12
    r = F.when(flat, F.lit(0.0)).otherwise(det / (2.0 * s * s * s))
    phi = F.acos(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))) / 3.0
    p = p.withColumn("_phi", phi)
    third = 2.0943951023931953  # fixed value: 2 pi / 3
    p = p.withColumn("_l1", q + 2.0 * s * F.cos("_phi")).withColumn("_l3", q + 2.0 * s * F.cos(F.col("_phi") + third))
    p = p.withColumn("_l2", F.col("_t") - F.col("_l1") - F.col("_l3"))

    def root(v: Column) -> Column:
        return F.when(v <= F.col("_t") * NOISE, F.lit(0.0)).otherwise(F.sqrt(v * 10.0))

    l3 = F.col("_l3")
    adj = [(b - l3) * (c - l3) - f * f, (a - l3) * (c - l3) - e * e, (a - l3) * (b - l3) - d * d]
    for n, v in zip(ZYX, adj):
        p = p.withColumn(f"_g{n}", F.abs(v))
    top = F.greatest("_gz", "_gy", "_gx")
    tie = top * (1 - 10 * NOISE)
    double = top <= F.col("_t") * F.col("_t") * NOISE  # smallest eigenvalue is repeated
    low = F.least(a, b, c) * (1 + 1e-12)
    direction = (
        F.when(double & (a <= low), "Z")
        .when(double & (b <= low), "Y")
        .when(double, "X")
        .when(F.col("_gz") >= tie, "Z")
        .when(F.col("_gy") >= tie, "Y")
        .otherwise("X")
    )
    return p.withColumns(
        {
            "axis_major": root(F.col("_l1") + F.col("_l2") - F.col("_l3")),
            "axis_minor": root(F.col("_l2") + F.col("_l3") - F.col("_l1")),
            "principal_axis_dir": direction,
        }
    ).drop("_t", "_q", "_p", "_phi", "_l1", "_l2", "_l3", "_gz", "_gy", "_gx")


def axes_um(axes: DataFrame) -> DataFrame:
    """axis1/2/3_um and elongation; needs axis_major/minor, principal_axis_dir and sz, sy, sx."""
    own = (
        F.when(F.col("principal_axis_dir") == "Z", F.col("sz"))
        .when(F.col("principal_axis_dir") == "Y", F.col("sy"))
        .otherwise(F.col("sx"))
    )
    a = axes.withColumn("axis1_um", F.col("axis_major") * own).withColumn(
        "axis3_um", F.col("axis_minor") * ((F.col("sz") + F.col("sy") + F.col("sx")) / 3.0)
    )
    return a.withColumn("axis2_um", (F.col("axis1_um") + F.col("axis3_um")) / 2.0).withColumn(
        "elongation", F.col("axis1_um") / F.greatest("axis3_um", F.lit(1e-10))
    )


def intensity_stats(labels: DataFrame, voxels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, sum and std/mean of the image under each label; absent voxels count as 0."""
    v = labels.join(voxels.select(*keys, *ZYX, "value"), [*keys, *ZYX], "left")
    value = F.coalesce(F.col("value"), F.lit(0.0))
    s = v.groupBy(*keys, "label").agg(
        F.avg(value).alias("mean_intensity"), F.sum(value).alias("integrated_intensity"), F.stddev_pop(value).alias("_sd")
    )
    cv = F.when(F.col("mean_intensity") > 0, F.col("_sd") / F.col("mean_intensity")).otherwise(F.lit(0.0))
    return s.withColumn("intensity_cv", cv).drop("_sd")


def size_bounds(labels: DataFrame, keys: Sequence[str] = KEYS, default: int = 7500) -> DataFrame:
    """Smallest and largest cell per sample (the smallest falls back to ``default``)."""
    sizes = labels.filter("label > 0").groupBy(*keys, "label").count()
    found = sizes.groupBy(*keys).agg(F.min("count").alias("min_volume"), F.max("count").alias("max_volume"))
    every = labels.select(*keys).distinct()
    return every.join(found, list(keys), "left").withColumn("min_volume", F.coalesce("min_volume", F.lit(default)))


def flag_outliers(objs: DataFrame, bounds: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
    """is_volume_outlier: volume above max_ceiling or below min_floor; a missing bound never flags.

    ``bounds`` has one row (min_floor, max_ceiling), or one per value of ``on``.  Without ``on`` a second row is an error.
    """
    if not on:
        twice = F.count(F.lit(1)) > 1
        bounds = bounds.agg(*[F.when(twice, F.raise_error(F.lit("more than one row of bounds"))).otherwise(F.max(c)).alias(c)
                              for c in ("min_floor", "max_ceiling")])
    wide = objs.join(bounds, list(on), "left") if on else objs.join(F.broadcast(bounds), F.lit(True), "left")
    v = F.col("volume_vox")
    flag = F.coalesce(v > F.col("max_ceiling"), F.lit(False)) | F.coalesce(v < F.col("min_floor"), F.lit(False))
    return wide.withColumn("is_volume_outlier", flag).drop("min_floor", "max_ceiling")


def distinct_labels(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return labels.filter("label > 0").groupBy(*keys).agg(F.countDistinct("label").alias("n_labels"))


def stage_counts(stages: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Objects left after each named stage, in long form."""
    out = None
    for name, labels in stages.items():
        row = distinct_labels(labels, keys).withColumn("stage", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def cell_summary(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Compact per-cell table, largest first."""
    o = object_info(labels, keys)
    return o.select(
        *keys,
        "label",
        "volume_vox",
        *[F.bround(f"c{c}", 2).alias(f"centroid_{c}") for c in ZYX],
        *[F.col(f"{c}{e}").alias(f"bbox_{c}{e}") for e in "01" for c in ZYX],
    ).orderBy(*keys, F.desc("volume_vox"), "label")
