"""Sinks: statistics CSV, artefact tables, correction package, training samples, split manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..joins import by_site
from ..operators.masks import whole_quantiles
from ..operators.objects import cell_summary
from ..schemas import KEYS, ZYX
from .listing import artefact_name

# fixed values: column groups of the statistics table
GROUPS = {
    "centroid_vox": [f"centroid_{c}_vox" for c in ZYX],
    "centroid_um": [f"centroid_{c}_um" for c in ZYX],
    "bbox_vox": [f"bbox_{c}{e}_vox" for e in "01" for c in ZYX],
    "bbox_um": [f"bbox_d{c}_um" for c in ZYX],
    "nn_1st": ["nearest_neighbor_label", "nearest_neighbor_dist_um"],
    "nn_2nd": ["nearest_neighbor_2_label", "nearest_neighbor_2_dist_um"],
}


def expand_columns(df: DataFrame, wanted: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """label plus the wanted columns, groups expanded; names the table lacks are skipped."""
    names = ["label", *[c for w in wanted for c in GROUPS.get(w, [w])]]
    return df.select(*keys, *[c for c in dict.fromkeys(names) if c in df.columns])


def write_stats(df: DataFrame, path: str, wanted: Sequence[str], keys: Sequence[str] = KEYS, mode: str = "overwrite") -> None:
    expand_columns(df, wanted, keys).write.mode(mode).option("header", True).csv(path)


def write_artefact(df: DataFrame, root: str, kind: str, mode: int = 0) -> None:
    """Append one artefact (mask, brain_only, raw or corrected labels) under fish_id / artefact folders."""
    out = df.withColumn("artefact", F.lit(artefact_name(kind, mode)))
    spread = [c for c in ("z",) if c in df.columns]
    out.repartition("fish_id", *[F.floor(F.col(c) / 16) for c in spread]).write.mode("append").partitionBy(
        "artefact", "fish_id"
    ).parquet(root)


def package_manifest(parts: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """(sample, part, n_rows) of a correction package."""
    out = None
    for name, df in parts.items():
        row = df.groupBy(*keys).agg(F.count("*").alias("n_rows")).withColumn("part", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


GUIDE = (
    "Open the image with the corrected labels on top.",
    "Compare each label with the image; delete labels that are not cells.",
    "Split labels that hold two cells, join labels that are parts of one.",
    "Save the finished labels as the ground truth of this sample.",
)


def build_package(root: str, voxels: DataFrame, corrected: DataFrame, raw: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Write image, corrected and raw labels, per-cell summary and guide under ``root``; returns the manifest."""
    parts = {"image": voxels, "corrected": corrected, "raw": raw, "summary": cell_summary(corrected, keys)}
    for name, df in parts.items():
        df.write.mode("overwrite").partitionBy(*keys).parquet(f"{root}/{name}")
    spark = voxels.sparkSession
    spark.createDataFrame(list(enumerate(GUIDE, 1)), "step int, text string").write.mode("overwrite").json(f"{root}/guide")
    manifest = package_manifest(parts, keys)
    manifest.write.mode("overwrite").json(f"{root}/manifest")
    return manifest


def training_samples(
    voxels: DataFrame,
    mask: DataFrame,
    volumes: DataFrame,
    mask_volumes: DataFrame | None = None,
    brain_only: DataFrame | None = None,
    skin_only: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
):
    """Training rows (value, mask, brain_only, skin_only per site) and per-sample attributes.

    brain_only / skin_only are cut from the volume where a sample has none of its
    own. Samples without a mask, or with a mask of another shape, are skipped.
    """
    keys = list(keys)
    dims = ["nz", "ny", "nx"]
    good = volumes.select(*keys, *dims).distinct()
    if mask_volumes is not None:
        good = good.join(mask_volumes.select(*keys, *dims).distinct(), [*keys, *dims], "left_semi")
    good = good.join(mask.select(*keys).distinct(), keys, "left_semi")
    v = voxels.select(*keys, *ZYX, "value").join(good.select(*keys), keys, "left_semi")
    m = mask.select(*keys, *ZYX, F.lit(1).alias("mask")).join(good.select(*keys), keys, "left_semi")
    rows = v.join(m, [*keys, *ZYX], "full").na.fill(0.0, ["value"]).na.fill(0, ["mask"])
    attrs = good
    for name, df, cut in (
        ("brain_only", brain_only, F.col("value") * F.col("mask")),
        ("skin_only", skin_only, F.col("value") * (1 - F.col("mask"))),
    ):
        if df is None:
            rows = rows.withColumn(name, cut)
            attrs = attrs.withColumn(f"has_{name}", F.lit(False))
            continue
        own = df.select(*keys).distinct().withColumn(f"has_{name}", F.lit(True))
        given = df.select(*keys, *ZYX, F.col("value").alias("_given"))
        rows = rows.join(by_site(given), [*keys, *ZYX], "left").join(own, keys, "left")
        rows = rows.withColumn(name, F.when(F.col(f"has_{name}"), F.coalesce("_given", F.lit(0.0))).otherwise(cut))
        rows = rows.drop("_given", f"has_{name}")
        attrs = attrs.join(own, keys, "left").na.fill(False, [f"has_{name}"])
    whole = good.join(volumes.select(*keys, *dims).distinct(), [*keys, *dims])
    q = whole_quantiles(v, whole, {"volume_min": 0.0, "volume_p01": 0.01, "volume_p99": 0.99, "volume_max": 1.0}, keys)
    return rows, attrs.join(q, keys)


def split_manifest(split: DataFrame, id_col: str = "fish_id") -> DataFrame:
    """Samples per split; ids themselves stay rows and are never gathered into one."""
    return split.groupBy("split").agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))


def write_manifest(split: DataFrame, path: str, seed: int = 16, id_col: str = "fish_id") -> None:
    """JSON manifest: one line per sample, one folder per split."""
    split.select("split", id_col, F.lit(seed).alias("seed")).write.mode("overwrite").partitionBy("split").json(path)
