"""Label-set operators: filters, renumbering, joins, splice and creation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..joins import spread_join
from ..numbering import number_rows
from ..schemas import KEYS, ZYX
from .components import components
from .stencils import fill_holes2d, smooth_mask

FRACTION = 0.618  # fixed value: share of the minimum volume a cell must reach


def size_floor(min_volume: float, fraction: float = FRACTION) -> int:
    return max(1, round(fraction * min_volume))


def volumes_of(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return labels.groupBy(*keys, "label").agg(F.count("*").alias("volume_vox"))


def filter_small(labels: DataFrame, min_volume: float, fraction: float = FRACTION, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep labels whose voxel count reaches max(1, round(fraction * min_volume))."""
    keep = volumes_of(labels, keys).filter(F.col("volume_vox") >= size_floor(min_volume, fraction))
    return labels.join(keep, [*keys, "label"], "left_semi")


def final_min_size(labels: DataFrame, gt_min: float, fraction: float = FRACTION, keys: Sequence[str] = KEYS):
    """The same rule as a last safety net; also returns the removed count per sample."""
    sizes = volumes_of(labels, keys)
    small = F.col("volume_vox") < size_floor(gt_min, fraction)
    removed = sizes.groupBy(*keys).agg(F.sum(small.cast("int")).alias("n_removed"))
    return labels.join(sizes.filter(small), [*keys, "label"], "left_anti"), removed


def remove_debris(labels: DataFrame, threshold: int, keys: Sequence[str] = KEYS):
    """Drop connected pieces below ``threshold`` voxels from each label; ids stay. Returns (labels, counts)."""
    pieces = components(labels, keys, 26, within=["label"])
    sizes = pieces.groupBy(*keys, "label", "component").count()
    small = sizes.filter(F.col("count") < threshold)
    kept = pieces.join(small, [*keys, "label", "component"], "left_anti").select(*keys, *ZYX, "label")
    removed = sizes.groupBy(*keys).agg(F.sum((F.col("count") < threshold).cast("int")).alias("n_removed"))
    return kept, removed


def apply_lut(labels: DataFrame, lut: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Replace label by lut.new_label; labels missing from the table are dropped."""
    return labels.join(lut.select(*keys, "label", "new_label"), [*keys, "label"]).select(
        *keys, *ZYX, F.col("new_label").alias("label")
    )


def relabel_by_volume(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """1..N by falling volume; of equal volumes the higher old id comes first."""
    lut = number_rows(volumes_of(labels, keys), keys, [F.desc("volume_vox"), F.desc("label")], "new_label")
    return apply_lut(labels, lut, keys)


def relabel_sequential(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    lut = number_rows(labels.select(*keys, "label").distinct(), keys, [F.asc("label")], "new_label")
    return apply_lut(labels, lut, keys)


def resort_labels(
    labels: DataFrame, by: str = "size", reverse: bool = False, keys: Sequence[str] = KEYS, complexity: DataFrame | None = None
) -> DataFrame:
    """Renumber by size (falling), centroid_z/y/x (rising) or complexity (falling).

    ``reverse`` flips the order; equal keys stay in rising id order either way.
    For complexity pass a table (label, n_branches).
    """
    if by == "size":
        score, falling = volumes_of(labels, keys).withColumnRenamed("volume_vox", "_s"), True
    elif by == "complexity":
        if complexity is None:
            from .shape import branch_stats, skeleton_branches

            complexity = branch_stats(skeleton_branches(labels, keys=keys), labels, keys)
        score, falling = complexity.select(*keys, "label", F.col("n_branches").alias("_s")), True
    elif by in ("centroid_z", "centroid_y", "centroid_x"):
        score, falling = labels.groupBy(*keys, "label").agg(F.avg(by[-1]).alias("_s")), False
    else:
        raise ValueError(f"unknown order {by!r}")
    key = F.desc("_s") if falling != reverse else F.asc("_s")
    return apply_lut(labels, number_rows(score, keys, [key, F.asc("label")], "new_label"), keys)


def join_labels(labels: DataFrame, requests: DataFrame, keys: Sequence[str] = KEYS, check: bool = True) -> DataFrame:
    """Merge label_b into label_a for a table of requests (label_a, label_b).

    Each label_b may be named once. With ``check`` equal or missing labels raise.
    """
    keys = list(keys)
    if check:
        if requests.filter("label_a = label_b").take(1):
            raise ValueError("label_a and label_b must differ")
        asked = requests.select(*keys, F.explode(F.array("label_a", "label_b")).alias("label"))
        if asked.join(labels, [*keys, "label"], "left_anti").take(1):
            raise ValueError("requested label not found")
    move = requests.select(*keys, F.col("label_b").alias("label"), F.col("label_a").alias("_to"))
    return labels.join(move, [*keys, "label"], "left").select(*keys, *ZYX, F.coalesce("_to", "label").alias("label"))


def splice(labels: DataFrame, new_labels: DataFrame, requests: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Replace each requested label by the new objects that touch its old footprint.

    ``requests``: (label); one label per sample. Kept objects get ids after the
    current maximum, in id order, and overwrite neighbours they cover.
    """
    keys = list(keys)
    footprint = labels.join(requests, [*keys, "label"], "left_semi").select(*keys, *ZYX)
    rest = labels.join(requests, [*keys, "label"], "left_anti")
    hit = new_labels.join(footprint, [*keys, *ZYX], "left_semi").select(*keys, "label").distinct()
    top = rest.groupBy(*keys).agg(F.max("label").alias("_top"))
    ids = number_rows(hit, keys, [F.asc("label")], "_n").join(top, keys, "left")
    ids = ids.select(*keys, "label", (F.coalesce("_top", F.lit(0)) + F.col("_n")).alias("new_label"))
    added = apply_lut(new_labels, ids, keys)
    return rest.join(added, [*keys, *ZYX], "left_anti").select(*keys, *ZYX, "label").unionByName(added)


def create_labels(
    voxels: DataFrame,
    volumes: DataFrame,
    sigma_xy: float = 1.0,
    sigma_z: float = 0.5,
    min_volume: float | DataFrame = 7500,
    min_hole_size: int | DataFrame = 0,
    fraction: float = FRACTION,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """value > 0 -> smooth -> fill holes per slice -> 26-components -> size floor -> 1..N by volume.

    Both sizes may be a table per sample: some of ``keys`` and a column of the size's name.
    """
    binary = voxels.filter("value > 0").select(*keys, *ZYX)
    smooth = smooth_mask(binary, volumes, sigma_xy, sigma_z, keys)
    return label_mask(fill_holes2d(smooth, min_hole_size, keys), min_volume, fraction, keys)


def label_mask(mask: DataFrame, min_volume: float | DataFrame, fraction: float = FRACTION, keys: Sequence[str] = KEYS) -> DataFrame:
    """The tail of ``create_labels``: components, size floor, numbering by volume."""
    keys = list(keys)
    found = components(mask, keys, 26)
    sizes = found.groupBy(*keys, "component").agg(F.count("*").alias("_n"))
    if isinstance(min_volume, DataFrame):
        own = [k for k in keys if k in min_volume.columns]
        sizes = spread_join(sizes, min_volume.select(*own, "min_volume"), own, ["component"])
        sizes = sizes.filter(F.col("_n") >= F.bround(F.col("min_volume") * float(fraction))).drop("min_volume")
    else:
        sizes = sizes.filter(F.col("_n") >= size_floor(min_volume, fraction))
    ids = number_rows(sizes, keys, [F.desc("_n"), F.desc("component")], "label")
    return found.join(ids.select(*keys, "component", "label"), [*keys, "component"]).select(*keys, *ZYX, "label")
