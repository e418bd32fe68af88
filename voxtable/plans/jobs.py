"""Composed jobs: what a user calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..bricks import from_words
from ..functions.describe import describe_with
from ..functions.regions import assign_regions
from ..functions.scalar import branch_ratios, clark_evans, depth_normalized, eq_diam, morphotype, sphericity, to_um
from ..joins import spread_join
from ..operators import crops as C, outlines as O
from ..operators.labels import (
    FRACTION, create_labels, final_min_size, relabel_sequential, splice,
)
from ..operators.masks import (
    apply_mask, background_mode, erode_mask, fill_outside_random, invert_mask, lattice,
    mask_scores, postprocess, remove_global, remove_outside, value_range,
)
from ..operators.merging import gmm_cleanup, large_contact_merge, safe_merge
from ..operators.objects import (
    axes_um, flag_outliers, intensity_stats, object_info, principal_axes, regionprops, size_bounds, stage_counts,
)
from ..operators.pairs import assign_fragments, nearest_two, radius_count, should_merge_samples, should_not_merge_samples
from ..operators.scoring import best_match, recommend_merge, score_against_gt
from ..operators.shape import branch_diameters, branch_stats, complex_cells, recommend_branch_radius, skeleton_branches, solidity, surface_area
from ..operators.stencils import erode2d, slice_holes, z_median3
from ..operators.sweeps import best_point, cross_grid, recommend_all, split_samples, sweep_avg
from ..schemas import KEYS, ZYX
from ..session import is_empty, materialize
from ..sources.listing import gt_samples
from ..sources.sinks import split_manifest, training_samples


def brain_extraction(
    probs: DataFrame, voxels: DataFrame, volumes: DataFrame, threshold: float = 0.5, erosion: int = 0, mode: int = 0,
    tol: float = 0.05, signal_erosion: int = 0, seed: int = 0, keys: Sequence[str] = KEYS,
):
    """Mask from a probability map, then brain-only voxels by background mode.

    Modes: 0 cut only, 1 exterior removed, 2 global removal, 3 random fill outside.
    Returns (un-eroded mask, brain-only voxels).
    """
    mask = materialize(postprocess(probs, threshold, keys), "mask")
    used = materialize(erode_mask(mask, volumes, erosion, keys), "eroded") if erosion > 0 else mask
    only = apply_mask(voxels, used, keys)
    if mode > 0:
        only = materialize(only, "brain-only")
    if mode == 1:
        only = remove_outside(only, used, volumes, tol, keys)
    elif mode == 2:
        only = remove_global(only, used, volumes, tol, signal_erosion, keys)
    elif mode == 3:
        only = fill_outside_random(only, used, volumes, seed, keys)
    return mask, only


def correct_labels(
    fragments: DataFrame, scales: DataFrame, max_gap: float = 1.0, min_contact: int = 10, large_contact: int = 20,
    gt_min: float = 10230, fraction: float = FRACTION, porous_below: float = 0.5, keys: Sequence[str] = KEYS,
):
    """Size cut-off -> safe merge -> contact merge -> size floor -> 1..N. Returns (labels, stage counts, porous labels)."""
    stages = {"raw": fragments}
    cut, _ = gmm_cleanup(fragments, keys)
    stages["gmm"] = cut = materialize(cut, "gmm")
    stages["safe_merge"] = merged = materialize(safe_merge(cut, scales, max_gap, min_contact, gt_min, keys), "safe")
    stages["large_contact"] = joined = materialize(large_contact_merge(merged, large_contact, keys), "contact")
    kept, _ = final_min_size(joined, gt_min, fraction, keys)
    stages["final"] = final = materialize(relabel_sequential(kept, keys), "final")
    solid = solidity(final, keys)
    return final, stage_counts(stages, keys), solid.filter(F.col("solidity") < porous_below)


def shape_columns(labels: DataFrame, scale_zyx: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """Solidity, mesh area and skeleton columns per label, as a branch that is joined only when wanted."""
    s = branch_stats(skeleton_branches(labels, scale_zyx, keys), labels, keys)
    return s.join(solidity(labels, keys), [*keys, "label"]).join(surface_area(labels, scale_zyx, keys), [*keys, "label"])


def spatial_columns(objs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Neighbour, density and depth columns from centroids already rounded to 2 decimals."""
    pts = objs.select(*keys, "label", *[F.col(f"centroid_{c}_um").alias(c) for c in ZYX])
    out = objs.join(nearest_two(pts, keys), [*keys, "label"])
    out = out.join(radius_count(pts, 100.0, keys).withColumnRenamed("n_within", "local_density_100um"), [*keys, "label"])
    out = clark_evans(depth_normalized(out, keys=keys), keys=keys)
    few = {"nearest_neighbor_dist_um": 2, "nearest_neighbor_2_dist_um": 2, "nearest_neighbor_ratio": 4, "depth_normalized": 4}
    return out.withColumns({c: F.bround(c, d) for c, d in few.items()})


def base_columns(labels: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Size, place, box, axes and extent: one aggregation over voxels."""
    o = axes_um(principal_axes(to_um(regionprops(labels, keys), volumes, keys)))
    o = o.withColumn("_elong", F.col("elongation"))
    return o.withColumns(
        {
            "eq_diam_um": F.bround(eq_diam("_vol"), 2),
            **{c: F.bround(c, 2) for c in ("axis1_um", "axis2_um", "axis3_um")},
            "elongation": F.bround("elongation", 3),
            "extent": F.bround("extent", 4),
        }
    )


def compute_stats(
    labels: DataFrame, volumes: DataFrame, scale_zyx: Sequence[float], voxels: DataFrame | None = None,
    boundaries: DataFrame | None = None, region_names: DataFrame | None = None, bounds: DataFrame | None = None,
    describe: Column | None = None, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The statistics table: one row per label.

    Intensity, region and outlier columns come only with their inputs. Column
    groups are separate branches, so a later projection prunes what it does not use.
    """
    keys = list(keys)
    o = base_columns(labels, volumes, keys).join(shape_columns(labels, scale_zyx, keys), [*keys, "label"])
    o = o.withColumn("_spher", sphericity("_vol", "surface_area_um2"))
    o = branch_ratios(o)
    o = o.withColumn("morphotype", morphotype("_spher", "solidity", "_elong", "n_branches", "surface_to_volume_ratio"))
    o = o.withColumns(
        {
            "sphericity": F.bround("_spher", 4),
            "solidity": F.bround("solidity", 4),
            "surface_area_um2": F.bround("surface_area_um2", 2),
            "mean_branch_len_um": F.bround("mean_branch_len_um", 2),
            "max_branch_len_um": F.bround("max_branch_len_um", 2),
            "branch_tortuosity": F.bround("branch_tortuosity", 4),
        }
    )
    names = [f"centroid_{c}_{u}" for u in ("vox", "um") for c in ZYX]
    o = o.select(
        *keys, "label", "volume_vox", "volume_um3", *names,
        *[F.col(f"{c}{e}").alias(f"bbox_{c}{e}_vox") for e in "01" for c in ZYX], *[f"bbox_d{c}_um" for c in ZYX],
        "eq_diam_um", "axis1_um", "axis2_um", "axis3_um", "elongation", "principal_axis_dir", "solidity", "extent",
        "surface_area_um2", "sphericity", "surface_to_volume_ratio", "n_branches", "n_endpoints", "mean_branch_len_um",
        "max_branch_len_um", "branch_tortuosity", "branch_density", "endpoint_density", "process_complexity", "morphotype",
    )
    o = materialize(o, "stats")
    if voxels is not None:
        i = intensity_stats(labels, voxels, keys)
        o = o.join(
            i.select(*keys, "label", F.bround("mean_intensity", 2).alias("mean_intensity"),
                     F.bround("integrated_intensity", 2).alias("integrated_intensity"), F.bround("intensity_cv", 4).alias("intensity_cv")),
            [*keys, "label"],
        )
    o = spatial_columns(o, keys)
    if boundaries is not None:
        pts = o.select(*keys, "label", F.col("centroid_y_um").alias("y"), F.col("centroid_x_um").alias("x"))
        r = assign_regions(pts, boundaries, region_names, keys)
        o = o.join(r.withColumn("region_boundary_dist_um", F.bround("region_boundary_dist_um", 2)), [*keys, "label"])
    o = describe_with(o, describe)
    return o if bounds is None else flag_outliers(o, bounds)


def mask_sweep(
    probs: DataFrame, gt: DataFrame, volumes: DataFrame, thresholds: Sequence[float], erosions: Sequence[int], keys: Sequence[str] = KEYS
):
    """Threshold x erosion grid scored by Dice. Returns (results, best point per sample).

    All thresholds run as one job with the threshold as an extra key.
    """
    keys = list(keys)
    wide = [*keys, "p1"]
    cut = cross_grid(probs, [(t, 0.0) for t in thresholds]).drop("p2").filter("p > p1")
    masks = materialize(postprocess(cut, -1.0, wide), "masks")
    dims = cross_grid(volumes, [(t, 0.0) for t in thresholds]).drop("p2")
    out = None
    for e in erosions:
        s = mask_scores(erode_mask(masks, dims, int(e), wide), gt, keys, ["p1"])
        # A grid point whose mask vanished still scores 0.
        every = dims.select(*wide).distinct().join(gt.groupBy(*keys).agg(F.count("*").alias("_gt")), keys)
        s = every.join(s, wide, "left").na.fill(0).withColumn("gt_vox", F.col("_gt")).drop("_gt")
        s = s.withColumn("p2", F.lit(float(e)))
        out = s if out is None else out.unionByName(s)
    out = materialize(out, "sweep")
    return out, best_point(out, ["dice"], keys)


def voxel_sweep(probs: DataFrame, gt: DataFrame, cuts: Sequence[float], keys: Sequence[str] = KEYS):
    """Probability cut-offs scored per voxel (foreground = p > cut). Returns (results, best per sample).

    The truth flag is joined once; each cut is a conditional count, so the map
    is neither repeated nor re-read per cut.
    """
    keys = list(keys)
    g = gt.select(*keys, *ZYX).withColumn("_g", F.lit(1))
    flagged = probs.select(*keys, *ZYX, "p").join(g, [*keys, *ZYX], "full")
    hit = {i: F.col("p") > float(c) for i, c in enumerate(cuts)}
    agg = flagged.groupBy(*keys).agg(
        F.count("_g").alias("gt_vox"),
        *[F.count(F.when(h, 1)).alias(f"p{i}") for i, h in hit.items()],
        *[F.count(F.when(h & F.col("_g").isNotNull(), 1)).alias(f"t{i}") for i, h in hit.items()],
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(float(c)).alias("p1"), F.col(f"p{i}").alias("pred_vox"), F.col(f"t{i}").alias("tp")) for i, c in enumerate(cuts)])
    )
    r = agg.select(*keys, "gt_vox", rows.alias("_r")).select(*keys, "_r.p1", F.lit(0.0).alias("p2"), "_r.pred_vox", "gt_vox", "_r.tp")

    def pct(num, den):
        return F.when(den > 0, num * 100.0 / den).otherwise(F.lit(0.0))

    tp, pv, gv = F.col("tp"), F.col("pred_vox"), F.col("gt_vox")
    r = r.withColumn("dice", pct(2 * tp, pv + gv)).withColumn("iou", pct(tp, pv + gv - tp))
    return r, best_point(r, ["dice"], keys)


def _cell_crops(rows: DataFrame, objs: DataFrame, volumes: DataFrame, pad_z: int, pad_xy: int, keys: list[str]):
    """Rows in crop coordinates keyed by cell_label, and the crop shapes as volumes."""
    cut = C.bbox_crop(rows, objs, volumes, pad_z, pad_xy, keys)
    moved = cut.withColumns({c: (F.col(c) - F.col(f"{c}0")).cast("int") for c in ZYX})
    return moved.drop(*[f"{c}{e}" for c in ZYX for e in "01"])


def _crop_shapes(objs: DataFrame, volumes: DataFrame, pad_z: int, pad_xy: int, keys: list[str]) -> DataFrame:
    v = objs.join(volumes.select(*keys, "nz", "ny", "nx").distinct(), keys)
    for c, pad in zip(ZYX, (pad_z, pad_xy, pad_xy)):
        v = v.withColumn(
            f"n{c}", F.least(F.col(f"{c}1") + pad, F.col(f"n{c}")) - F.greatest(F.col(f"{c}0") - pad, F.lit(0))
        )
    return v.select(*keys, F.col("label").alias("cell_label"), "nz", "ny", "nx")


def _score_crops(pred: DataFrame, cells: DataFrame, wide: list[str], keys: list[str], point: Sequence[str]) -> DataFrame:
    """Best match of the crop's own cell; crops without any prediction score 0."""
    scope = [*keys, "cell_label"]
    truth = cells.filter("label = cell_label").select(*scope, *ZYX, "label")
    hits = best_match(pred, truth, scope, point)
    return hits.select(*keys, F.col("cell_label").alias("label"), *point, "iou", "dice", "pred_vox", "size_delta")


def _with_empty(results: DataFrame, cells: DataFrame, points, keys: list[str]) -> DataFrame:
    every = cross_grid(cells.select(*keys, "label"), points)
    r = every.join(results, [*keys, "label", "p1", "p2"], "left").na.fill(0, ["iou", "dice", "pred_vox"])
    return r.na.fill(-100.0, ["size_delta"])


def sweep_cells(
    gt: DataFrame, cells: DataFrame | None, scale_zyx: Sequence[float], n_cells: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, label) of the cells a sweep scores: the given ones, or each sample's ``n_cells`` with most branches.

    Raises if no sample has a labelled cell.
    """
    keys = list(keys)
    if cells is None:
        cells = complex_cells(gt, scale_zyx, n_cells, keys)
    cells = materialize(cells.select(*keys, "label").distinct(), "sweep-cells")
    if is_empty(cells):
        raise ValueError("ground truth holds no labelled cell")
    return cells


def sweep_sizes(
    gt: DataFrame, min_volume: float | DataFrame | None, min_hole_size: int | DataFrame | None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, min_volume, min_hole_size) per sample: the given numbers or tables, or what its ground truth shows."""
    keys = list(keys)

    def size(given, name: str, measured) -> DataFrame:
        if given is None or isinstance(given, DataFrame):
            return (measured() if given is None else given).select(*keys, name)
        return gt.select(*keys).distinct().withColumn(name, F.lit(given))

    low = size(min_volume, "min_volume", lambda: size_bounds(gt, keys))
    hole = size(min_hole_size, "min_hole_size", lambda: smallest_holes(gt, keys=keys))
    return materialize(low.join(hole, keys), "sweep-sizes")


def _best_with_sizes(avg: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    used = sizes.withColumnsRenamed({"min_volume": "min_volume_used", "min_hole_size": "min_hole_size_used"})
    return best_point(avg, ["iou"], keys).join(used, keys)


def background_sweep(
    voxels: DataFrame, mask: DataFrame, gt: DataFrame, volumes: DataFrame, cells: DataFrame | None, thresholds: Sequence[float],
    erosions: Sequence[int], sigma_xy: float = 1.5, sigma_z: float = 3.0, min_volume: float | DataFrame | None = None,
    min_hole_size: int | DataFrame | None = None, fraction: float = FRACTION, pad_z: int = 15, pad_xy: int = 40,
    scale_zyx: Sequence[float] = (1.0, 1.0, 1.0), n_cells: int = 5, keys: Sequence[str] = KEYS,
):
    """Background threshold (p1) x erosion (p2) over ``cells`` (label; None: the ``n_cells`` most branched per sample).

    Sizes left out are measured on each sample's ground truth. Returns (results, averages, best with the sizes used).
    """
    keys = list(keys)
    cells = sweep_cells(gt, cells, scale_zyx, n_cells, keys)
    sizes = sweep_sizes(gt, min_volume, min_hole_size, keys)
    objs = object_info(gt, keys).join(cells, [*keys, "label"], "left_semi")
    objs = materialize(objs, "cells")
    base = background_mode(voxels, mask, keys).join(
        value_range(voxels, volumes, keys).select(*keys, (F.col("v_max") - F.col("v_min")).alias("_range")), keys
    )
    src = spread_join(apply_mask(voxels, mask, keys), base, keys, ZYX)
    crop = materialize(_cell_crops(src.select(*keys, *ZYX, "value", "mode", "_range"), objs, volumes, pad_z, pad_xy, keys), "crops")
    truth = _cell_crops(gt.select(*keys, *ZYX, "label"), objs, volumes, pad_z, pad_xy, keys)
    shapes = cross_grid(_crop_shapes(objs, volumes, pad_z, pad_xy, keys), [(t, 0.0) for t in thresholds]).drop("p2")
    kept = cross_grid(crop, [(t, 0.0) for t in thresholds]).drop("p2").filter("value > mode + _range * p1 / 100.0 and value > 0")
    wide = [*keys, "cell_label", "p1"]
    out = None
    for e in erosions:
        signal = erode2d(kept, shapes, int(e), wide).withColumn("value", F.lit(1.0))
        labels = create_labels(signal, shapes, sigma_xy, sigma_z, sizes, sizes, fraction, wide)
        r = _score_crops(labels, truth, wide, keys, ["p1"]).withColumn("p2", F.lit(float(e)))
        out = r if out is None else out.unionByName(r)
    out = materialize(_with_empty(out, objs, [(t, e) for t in thresholds for e in erosions], keys), "sweep")
    avg = sweep_avg(out, None, keys)
    return out, avg, _best_with_sizes(avg, sizes, keys)


def sigma_sweep(
    brain_only: DataFrame, gt: DataFrame, volumes: DataFrame, cells: DataFrame | None, sigma_xys: Sequence[float],
    sigma_zs: Sequence[float], min_volume: float | DataFrame | None = None, min_hole_size: int | DataFrame | None = None,
    fraction: float = FRACTION, pad_z: int = 15, pad_xy: int = 40, scale_zyx: Sequence[float] = (1.0, 1.0, 1.0), n_cells: int = 5,
    keys: Sequence[str] = KEYS,
):
    """Smoothing grid (p1 = sigma_xy, p2 = sigma_z) over ``cells``; crops are cut once.

    Cells and sizes left out as in ``background_sweep``. Returns (results, averages, best with the sizes used).
    """
    keys = list(keys)
    cells = sweep_cells(gt, cells, scale_zyx, n_cells, keys)
    sizes = sweep_sizes(gt, min_volume, min_hole_size, keys)
    objs = object_info(gt, keys).join(cells, [*keys, "label"], "left_semi")
    objs = materialize(objs, "cells")
    crop = materialize(_cell_crops(brain_only.select(*keys, *ZYX, "value"), objs, volumes, pad_z, pad_xy, keys), "crops")
    truth = _cell_crops(gt.select(*keys, *ZYX, "label"), objs, volumes, pad_z, pad_xy, keys)
    shapes = _crop_shapes(objs, volumes, pad_z, pad_xy, keys)
    wide = [*keys, "cell_label"]
    points, out = [(a, b) for a in sigma_xys for b in sigma_zs], None
    for a, b in points:
        labels = create_labels(crop, shapes, a, b, sizes, sizes, fraction, wide)
        r = _score_crops(labels, truth, wide, keys, [])
        r = r.withColumn("p1", F.lit(float(a))).withColumn("p2", F.lit(float(b)))
        out = r if out is None else out.unionByName(r)
    out = materialize(_with_empty(out, objs, points, keys), "sweep")
    avg = sweep_avg(out, None, keys)
    return out, avg, _best_with_sizes(avg, sizes, keys)


def fragment_sweep(
    fragments: DataFrame, gt: DataFrame, scales: DataFrame, large_contacts: Sequence[int], keys: Sequence[str] = KEYS,
    iou_threshold: float = 0.5, **correction,
):
    """Cut (p1, a column of ``fragments``) x contact threshold grid scored against ground truth. Returns (results, best)."""
    keys = list(keys)
    wide = [*keys, "p1"]
    cuts = materialize(fragments.select(*wide).distinct(), "cuts")
    wide_gt = gt.join(cuts, keys)
    wide_scales = scales.join(cuts, keys)
    out = None
    for c in large_contacts:
        final, _, _ = correct_labels(fragments, wide_scales, large_contact=int(c), keys=wide, **correction)
        s = score_against_gt(final, wide_gt, iou_threshold, wide).withColumn("p2", F.lit(float(c)))
        out = s if out is None else out.unionByName(s)
    out = materialize(out, "sweep")
    return out, best_point(out, ["score", "mean_iou", "mean_dice"], keys, needs_tp=True)


def measure_merge(pred: DataFrame, gt: DataFrame, scales: DataFrame, min_overlap: int = 5, pad_um: float = 3.0, keys: Sequence[str] = KEYS):
    """Gap and contact samples of fragment pairs. Returns (samples, per-sample counts)."""
    keys = list(keys)
    assigned = materialize(assign_fragments(pred, gt, min_overlap, keys), "assigned")
    yes = should_merge_samples(pred, assigned, scales, keys).select(*keys, "gap_um", "contact_vox").withColumn("kind", F.lit("should_merge"))
    no = should_not_merge_samples(pred, assigned, scales, pad_um, keys).select(*keys, "gap_um", "contact_vox").withColumn(
        "kind", F.lit("should_not_merge")
    )
    n_frag = pred.groupBy(*keys).agg(F.countDistinct("label").alias("n_fragments"))
    per_gt = assigned.groupBy(*keys, "gt").count()
    n_as = per_gt.groupBy(*keys).agg(
        F.sum("count").alias("n_assigned"), F.sum((F.col("count") > 1).cast("int")).alias("n_gt_fragmented")
    )
    counts = n_frag.join(n_as, keys, "left").na.fill(0)
    counts = counts.withColumn("n_dropped", F.col("n_fragments") - F.col("n_assigned")).drop("n_fragments")
    return yes.unionByName(no), counts


def merge_recommendation(pred: DataFrame, gt: DataFrame, scales: DataFrame, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    return recommend_merge(measure_merge(pred, gt, scales, keys=keys, **kw)[0], keys)


def checkpoint_sweep(
    preds: DataFrame, gt: DataFrame, epochs: DataFrame, cells: DataFrame | None = None,
    scale_zyx: Sequence[float] = (1.0, 1.0, 1.0), n_cells: int = 5, keys: Sequence[str] = KEYS,
):
    """Predicted label sets per epoch scored on true cells: ``cells`` (label), or each sample's most branched ones.

    Epochs without a prediction are skipped. Returns (results, averages, best).
    """
    keys = list(keys)
    true = gt.join(sweep_cells(gt, cells, scale_zyx, n_cells, keys), [*keys, "label"], "left_semi")
    use = preds.join(epochs, "epoch", "left_semi")
    r = best_match(use, true, keys, ["epoch"]).select(
        *keys, F.col("gt").alias("label"), F.col("epoch").cast("double").alias("p1"), F.lit(0.0).alias("p2"), "iou", "dice"
    )
    r = materialize(r, "sweep")
    avg = sweep_avg(r, None, keys)
    return r, avg, best_point(avg, ["iou"], keys)


def repoint(pointers: DataFrame, best: DataFrame, verified: DataFrame) -> DataFrame:
    """Pointer rows (model, target) after a checkpoint sweep: verified samples' best epoch replaces a different target.

    ``best``: model, fish_id, p1 = epoch; of several samples of a model the highest IoU decides.
    """
    win = best.join(verified.filter("verified").select("fish_id"), "fish_id").groupBy("model").agg(
        F.max_by("p1", F.struct("iou", -F.col("p1"))).cast("int").alias("_epoch")
    )
    target = F.coalesce(F.format_string("%s_epoch_%04d", "model", "_epoch"), F.col("target"))
    out = pointers.join(win, "model", "left")
    return out.select("model", F.when(F.col("_epoch").isNull(), F.col("target")).otherwise(target).alias("target"))


def smallest_holes(gt: DataFrame, trust: int = 5, default: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Smallest hole of at least ``trust`` voxels inside any cell slice, per sample."""
    holes = slice_holes(gt, keys, ["label"]).filter(F.col("hole_size") >= trust)
    h = holes.groupBy(*keys).agg(F.min("hole_size").alias("_h"))
    every = gt.select(*keys).distinct().join(h, list(keys), "left")
    return every.select(*keys, F.coalesce("_h", F.lit(default)).alias("min_hole_size"))


def size_limits(gt: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, min_volume, max_volume, min_hole_size) that each sample's ground truth shows."""
    return size_bounds(gt, keys).join(smallest_holes(gt, keys=keys), list(keys))


def calibration_rows(
    gt: DataFrame, verified: DataFrame, ts: Column, keys: Sequence[str] = KEYS, limits: DataFrame | None = None
) -> DataFrame:
    """History rows measured straight from ground truth: size bounds and smallest hole of samples that allow it.

    ``verified``: fish_id, verified. ``limits``: ``size_limits`` if known already.
    """
    b = size_limits(gt, keys) if limits is None else limits
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("config_key"), F.col(c).cast("double").alias("value"))
            for k, c in (("min_volume_vox", "min_volume"), ("max_volume_vox", "max_volume"), ("min_hole_size_vox", "min_hole_size"))
        ]
    )
    h = b.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*").join(verified, list(keys))
    return h.select("config_key", "fish_id", "value", "verified", ts.alias("ts"))


def sweep_history(
    best: DataFrame, names: dict[str, str], verified: DataFrame, ts: Column, keys: Sequence[str] = KEYS, score: str | None = None
) -> DataFrame:
    """History rows from a sweep's best points, e.g. names={"p1": "monai_threshold", "p2": "erosion_voxels"}.

    ``score`` names the column that chose the points; it is kept as ``score``.
    """
    own = [] if score is None else [F.col(score).cast("double").alias("score")]
    rows = F.array(*[F.struct(F.lit(k).alias("config_key"), F.col(c).cast("double").alias("value")) for c, k in names.items()])
    h = best.select(*keys, F.explode(rows).alias("_r"), *own).select(*keys, "_r.*", *([] if score is None else ["score"]))
    h = h.join(verified, list(keys))
    return h.select("config_key", "fish_id", "value", "verified", ts.alias("ts"), *([] if score is None else ["score"]))


def calibrate(gt: DataFrame, verified: DataFrame, ts: Column, sweeps: Sequence[DataFrame] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """Recommended value per calibration key over all verified samples."""
    h = calibration_rows(gt, verified, ts, keys)
    for s in sweeps:
        h = h.unionByName(s)
    return recommend_all(h)


# fixed values: the calibration keys a sweep's grid columns stand for
SWEEP_KEYS = {
    "mask": {"p1": "monai_threshold", "p2": "erosion_voxels"},
    "background": {"p1": "bg_tolerance", "p2": "signal_erosion_voxels"},
    "sigma": {"p1": "sigma_xy", "p2": "sigma_z"},
    "fragments": {"p1": "cellpose_cellprob"},
}


def calibration_suite(
    gt: DataFrame, volumes: DataFrame, voxels: DataFrame, verified: DataFrame, ts: Column, scale_zyx: Sequence[float],
    probs: DataFrame | None = None, true_mask: DataFrame | None = None, fragments: DataFrame | None = None,
    thresholds: Sequence[float] = (0.3, 0.5, 0.7), erosions: Sequence[int] = (0, 1), tolerances: Sequence[float] = (0.0, 5.0),
    signal_erosions: Sequence[int] = (0, 1), sigma_xys: Sequence[float] = (0.5, 1.0), sigma_zs: Sequence[float] = (0.5,),
    large_contacts: Sequence[int] = (20,), n_cells: int = 5, pad_z: int = 15, pad_xy: int = 40, keys: Sequence[str] = KEYS,
    history: DataFrame | None = None, sigma_xy: float = 1.5, sigma_z: float = 3.0, **correction,
) -> tuple[DataFrame, DataFrame]:
    """Everything that ground truth can calibrate, in order; each step uses what the steps before it found.

    Size bounds and smallest holes; threshold and erosion of the brain mask (needs ``probs``: p, and ``true_mask``);
    background tolerance and signal erosion inside the true mask, smoothed by ``sigma_xy`` and ``sigma_z``; smoothing of what
    the best background leaves; branch radius; probability cut of ``fragments`` (a column p1). Steps whose inputs are absent
    are left out, as are samples a step cannot score. ``history`` holds earlier runs. Returns (history with this run's rows
    and the score each sweep reached, recommendations).
    """
    keys = list(keys)
    limits = materialize(size_limits(gt, keys), "limits")
    rows = [calibration_rows(gt, verified, ts, keys, limits)]
    cells = sweep_cells(gt, None, scale_zyx, n_cells, keys)
    if probs is not None and true_mask is not None:
        _, best = mask_sweep(probs, true_mask, volumes, thresholds, erosions, keys)
        rows.append(sweep_history(best, SWEEP_KEYS["mask"], verified, ts, keys, "dice"))
    if true_mask is not None:
        _, _, best = background_sweep(
            voxels, true_mask, gt, volumes, cells, tolerances, signal_erosions, sigma_xy, sigma_z, limits, limits, pad_z=pad_z,
            pad_xy=pad_xy, keys=keys,
        )
        best = materialize(best, "best-background")
        rows.append(sweep_history(best, SWEEP_KEYS["background"], verified, ts, keys, "iou"))
        only = best_background(voxels, true_mask, volumes, best, keys)
        _, _, best = sigma_sweep(only, gt, volumes, cells, sigma_xys, sigma_zs, limits, limits, pad_z=pad_z, pad_xy=pad_xy, keys=keys)
        rows.append(sweep_history(best, SWEEP_KEYS["sigma"], verified, ts, keys, "iou"))
    radius = recommend_branch_radius(branch_diameters(gt, scale_zyx, keys=keys), float(scale_zyx[2]), keys)
    rows.append(sweep_history(radius, {"branch_radius_px": "cellpose_branch_radius"}, verified, ts, keys))
    if fragments is not None:
        _, best = fragment_sweep(fragments, gt, volumes, large_contacts, keys, **correction)
        rows.append(sweep_history(best, SWEEP_KEYS["fragments"], verified, ts, keys, "score"))
    now = rows[0]
    for r in rows[1:]:
        now = now.unionByName(r, allowMissingColumns=True)
    now = materialize(now if history is None else history.unionByName(now, allowMissingColumns=True), "calibration")
    return now, recommend_all(now)


def best_background(voxels: DataFrame, mask: DataFrame, volumes: DataFrame, best: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Voxels that each sample's best tolerance (p1, percent) and erosion (p2) of a background sweep leave."""
    keys = list(keys)
    base = background_mode(voxels, mask, keys).join(
        value_range(voxels, volumes, keys).select(*keys, (F.col("v_max") - F.col("v_min")).alias("_range")), keys
    )
    cut = base.join(best.select(*keys, "p1", "p2"), keys)
    kept = spread_join(apply_mask(voxels, mask, keys), cut.select(*keys, "mode", "_range", "p1", "p2"), keys, ZYX)
    kept = kept.filter("value > mode + _range * p1 / 100.0 and value > 0").select(*keys, *ZYX, "value", "p2")
    kept = materialize(kept, "best-background")
    out = kept.filter("p2 <= 0").drop("p2")
    for e in (int(r[0]) for r in best.select("p2").distinct().collect()):  # one row per value of the swept grid
        if e > 0:
            mine = kept.filter(F.col("p2") == e).drop("p2")
            out = out.unionByName(apply_mask(mine, erode2d(mine, volumes, e, keys), keys))
    return out


def masks_from_outlines(polygons: DataFrame, volumes: DataFrame, voxels: DataFrame, keys: Sequence[str] = KEYS, check: bool = True):
    """Outlines -> brain mask (smoothed along z), brain-only and skin-only voxels. Raises if the mask is empty."""
    words = O.rasterize(O.interpolate_outlines(polygons, volumes, keys), volumes, keys, words=True)
    words = materialize(z_median3(words, volumes, keys), "mask")
    if check and not words.take(1):
        raise ValueError("mask is empty after rasterising")
    return from_words(words, keys), apply_mask(voxels, words, keys), invert_mask(voxels, words, keys)


def skin_mask(mask: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return invert_mask(lattice(volumes, keys), mask, keys)


def training_set(
    listing: DataFrame, voxels: DataFrame, mask: DataFrame, volumes: DataFrame, n_val: int = 5, n_test: int = 5, seed: int = 16,
    keys: Sequence[str] = KEYS,
):
    """Samples with a brain or skin mask file, split, with training rows and attributes. Returns (rows, attrs, manifest)."""
    brain = gt_samples(listing, "_brain_mask.tif").withColumn("positive", F.lit(True))
    skin = gt_samples(listing, "_skin_mask.tif").join(brain, "folder", "left_anti").withColumn("positive", F.lit(False))
    name = F.regexp_extract("folder", r"([^/]*)$", 1).alias("fish_id")
    split = materialize(split_samples(brain.unionByName(skin).select(name, "positive"), n_val, n_test, seed), "split")
    rows, attrs = training_samples(voxels, mask, volumes, keys=keys)
    member = split.select("fish_id", "split")
    return rows.join(member, "fish_id"), attrs.join(member, "fish_id"), split_manifest(split)


def crop_set(
    labels: DataFrame, volumes: DataFrame, crop_size: int = 512, per_slice: int = 5, per_orientation: int = 320, min_px: int = 10,
    seed: int = 42, threshold: float = 0.9, voxels: DataFrame | None = None, keys: Sequence[str] = KEYS,
):
    """Crops in three orientations, cleaned of cut-off and tiny labels.

    Returns (crops, label pixels, image pixels or None, clean-up summary).
    """
    slices = materialize(C.label_slices(labels, volumes, keys), "slices")
    crops = C.sample_crops(slices, C.slice_shapes(volumes, keys), crop_size, per_slice, per_orientation, min_px, seed, keys)
    crops = materialize(crops, "crops")
    px = C.cut_crops(slices, crops, crop_size, keys)
    kept, summary = C.clean_truncation(px, slices, threshold, keys)
    image = None if voxels is None else C.cut_crops(C.image_slices(voxels, volumes, keys), crops, crop_size, keys, "value")
    return crops, C.clean_crops(kept, keys=keys), image, summary


def rerun_object(
    labels: DataFrame, requests: DataFrame, fragments: DataFrame, scales: DataFrame, volumes: DataFrame, pad_z: int = 15,
    pad_xy: int = 40, keys: Sequence[str] = KEYS, **correction,
):
    """Correct new fragments in the padded box of one label per sample and splice the result back.

    ``requests``: label. Returns (labels, porous new labels).
    """
    keys = list(keys)
    objs = object_info(labels, keys).join(requests, [*keys, "label"], "left_semi")
    crop = C.bbox_crop(fragments.select(*keys, *ZYX, "label"), objs, volumes, pad_z, pad_xy, keys)
    crop = materialize(crop.select(*keys, *ZYX, "label"), "crop")
    fixed, _, _ = correct_labels(crop, scales, keys=keys, **correction)
    out = materialize(splice(labels, fixed, requests, keys), "spliced")
    new = out.select(*keys, "label").distinct().join(labels.select(*keys, "label").distinct(), [*keys, "label"], "left_anti")
    porous = solidity(out.join(new, [*keys, "label"], "left_semi"), keys).filter("solidity < 0.5")
    return out, porous
