"""Mask algebra, background removal, normalisation and mask agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..bricks import WORD, as_words
from ..joins import by_site, spread_by, spread_join
from ..numbering import quantiles
from ..schemas import KEYS, ZYX
from ..session import materialize
from .components import components, largest_component
from .stencils import erode2d, erode3d, fill_holes3d

N_BINS = 1000  # fixed value: bins of the background histogram


def lattice(volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every site of every volume. Rows are spread by slice before they multiply."""
    rows = volumes.select(*keys, "nz", "ny", "nx").withColumn("z", F.explode(F.expr("sequence(0, nz - 1)")))
    rows = rows.withColumn("y", F.explode(F.expr("sequence(0, ny - 1)"))).repartition(*keys, "z", "y")
    return rows.withColumn("x", F.explode(F.expr("sequence(0, nx - 1)"))).select(*keys, *ZYX)


def site_count(volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    sites = F.col("nz").cast("long") * F.col("ny") * F.col("nx")
    return volumes.select(*keys, sites.alias("n_sites"))


def value_range(voxels: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Whole-volume min and max, counting absent sites as 0 (the sparse-zero rule)."""
    seen = voxels.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    out = site_count(volumes, keys).join(seen, list(keys), "left")
    full = F.col("n") == F.col("n_sites")
    return out.select(
        *keys,
        F.when(full, F.col("lo")).otherwise(F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).alias("v_min"),
        F.when(full, F.col("hi")).otherwise(F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).alias("v_max"),
    )


def whole_quantiles(voxels: DataFrame, volumes: DataFrame, probs: dict[str, float], keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact quantiles over the whole lattice; the absent zeros enter as one weighted row."""
    seen = voxels.groupBy(*keys).agg(F.count("*").alias("n"))
    zeros = site_count(volumes, keys).join(seen, list(keys), "left").select(
        *keys, F.lit(0.0).alias("value"), (F.col("n_sites") - F.coalesce("n", F.lit(0))).alias("w")
    )
    rows = voxels.select(*keys, F.col("value").cast("double"), F.lit(1).cast("long").alias("w")).unionByName(zeros)
    return quantiles(rows, keys, "value", probs, "w")


def normalize(voxels: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """clip((v - p01) / max(p99 - p01, 1), 0, 1) at the occupied sites."""
    q = whole_quantiles(voxels, volumes, {"p01": 0.01, "p99": 0.99}, keys)
    span = F.greatest(F.col("p99") - F.col("p01"), F.lit(1.0))
    scaled = F.least(F.greatest((F.col("value") - F.col("p01")) / span, F.lit(0.0)), F.lit(1.0))
    return spread_join(voxels, q, keys, ZYX).withColumn("norm", scaled).drop("p01", "p99")


def binarize(df: DataFrame, condition: Column | str, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.filter(condition).select(*keys, *ZYX)


def _meet_mask(rows: DataFrame, mask: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows joined with the words of a mask (sites, or words as they are), so a dense one is not shuffled site by site."""
    line = [*keys, "z", "y", "w"]
    words = spread_by(mask, line) if "bits" in mask.columns else as_words(mask, keys)
    words = words.select(*[F.col(c).alias(f"_m_{c}") for c in (*line, "bits")])
    at = rows.withColumn("_w", F.floor(F.col("x") / WORD).cast("int"))
    on = F.getbit("_m_bits", F.pmod(F.col("x"), F.lit(WORD)).cast("int")) == 1
    for c in line:
        on = on & (F.col("_w" if c == "w" else c) == F.col(f"_m_{c}"))
    return at.join(by_site(words), on, how).drop("_w")


def apply_mask(voxels: DataFrame, mask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _meet_mask(voxels, mask, keys, "left_semi")


def invert_mask(rows: DataFrame, mask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows outside the mask: give voxels for skin-only, the lattice for the skin mask."""
    return _meet_mask(rows, mask, keys, "left_anti")


def mask_and(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return a.select(*keys, *ZYX).join(by_site(b), [*keys, *ZYX], "left_semi")


def mask_or(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return a.select(*keys, *ZYX).unionByName(b.select(*keys, *ZYX)).distinct()


def mask_andnot(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return a.select(*keys, *ZYX).join(by_site(b), [*keys, *ZYX], "left_anti")


def background_mode(voxels: DataFrame, mask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Centre of the first tallest of 1,000 equal bins over in-mask values, zeros included."""
    return _mode_of(apply_mask(voxels, mask, keys), mask, keys)


def _mode_of(inside: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mode from rows already known to lie in the mask; voxels are read once, the rest uses value counts."""
    keys = list(keys)
    inside = inside.groupBy(*keys, F.col("value").cast("double").alias("value")).count()
    inside = materialize(inside, "values")
    size = mask.groupBy(*keys).agg(F.count("*").alias("n_mask"))
    seen = inside.groupBy(*keys).agg(F.sum("count").alias("n_seen"))
    zeros = size.join(seen, keys, "left").select(
        *keys, F.lit(0.0).alias("value"), (F.col("n_mask") - F.coalesce("n_seen", F.lit(0))).alias("count")
    )
    hist = inside.unionByName(zeros.filter("count > 0"))
    ends = hist.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # A constant volume gets the unit-wide range around its value.
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        *keys,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    ends = materialize(ends, "ends")  # a known size, so that it is the side that travels
    cell = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * N_BINS), F.lit(N_BINS - 1))
    bins = spread_join(hist, ends, keys, ["value"], known=True).groupBy(*keys, "lo", "hi", cell.alias("bin")).agg(F.sum("count").alias("n"))
    best = bins.groupBy(*keys, "lo", "hi").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / N_BINS
    return best.select(*keys, (F.col("lo") + F.col("bin") * width + width / 2).alias("mode"))


def background_threshold(voxels, mask, volumes, tol: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """mode, data range and threshold = mode + (max - min) * tol / 100."""
    return _threshold_of(background_mode(voxels, mask, keys), voxels, volumes, tol, keys)


def _threshold_of(mode: DataFrame, voxels: DataFrame, volumes: DataFrame, tol: float, keys: Sequence[str]) -> DataFrame:
    rng = value_range(voxels, volumes, keys).select(*keys, (F.col("v_max") - F.col("v_min")).alias("data_range"))
    return mode.join(rng, list(keys)).withColumn(
        "thresh", F.col("mode") + F.col("data_range") * (tol / 100.0)
    )


def remove_outside(voxels, mask, volumes, tol: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop dim voxels outside the mask; everything inside stays."""
    keys = list(keys)
    flagged = voxels.join(by_site(mask.select(*keys, *ZYX).withColumn("_in", F.lit(True))), [*keys, *ZYX], "left")
    flagged = materialize(flagged, "flagged")
    mode = _mode_of(flagged.filter("_in"), mask, keys)
    cut = _threshold_of(mode, flagged, volumes, tol, keys).select(*keys, "thresh")
    return spread_join(flagged, cut, keys, ZYX).filter("_in or value > thresh").drop("_in", "thresh")


def remove_global(voxels, mask, volumes, tol: float, erosion: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop every voxel at or below the threshold, then erode the survivors per slice."""
    keys = list(keys)
    cut = background_threshold(voxels, mask, volumes, tol, keys).select(*keys, "thresh")
    cut = materialize(cut, "cut")  # a known size, so that it is the side that travels
    kept = spread_join(voxels, cut, keys, ZYX, known=True).filter("value > thresh").drop("thresh")
    if erosion <= 0:
        return kept
    return apply_mask(kept, erode2d(kept, volumes, erosion, keys), keys)


def unit_hash(seed: int, *cols) -> Column:
    """A repeatable uniform draw in [0, 1) per row; a retried task draws the same."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def fill_outside_random(voxels, mask, volumes, seed: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Replace every site outside the mask by noise of mode +- 0.1 % of the data range."""
    keys = list(keys)
    base = materialize(background_threshold(voxels, mask, volumes, 0.0, keys).select(*keys, "mode", "data_range"), "base")
    outside = spread_join(invert_mask(lattice(volumes, keys), mask, keys), base, keys, ZYX, known=True)
    half = F.col("data_range") * 0.001
    noise = F.col("mode") - half + unit_hash(seed, *keys, *ZYX) * half * 2
    noisy = outside.select(*keys, *ZYX, noise.alias("value"), F.lit(False).alias("inside"))
    inside = apply_mask(voxels, mask, keys).select(*keys, *ZYX, "value", F.lit(True).alias("inside"))
    return inside.unionByName(noisy)


def mask_scores(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = KEYS, by: Sequence[str] = ()) -> DataFrame:
    """dice, iou, precision, recall (x100) per sample; ``by`` adds sweep columns present in ``pred`` only."""
    scope = [*keys, *by]
    inter = apply_mask(pred, gt, keys).groupBy(*scope).agg(F.count("*").alias("tp"))
    p = pred.groupBy(*scope).agg(F.count("*").alias("pred_vox"))
    g = gt.groupBy(*keys).agg(F.count("*").alias("gt_vox"))
    if by:
        out = p.join(g, list(keys), "left")
    else:
        out = p.join(g, list(keys), "full")
    out = out.join(inter, scope, "left").na.fill(0, ["tp", "pred_vox", "gt_vox"])

    def pct(num, den):
        return F.when(den > 0, num * 100.0 / den).otherwise(F.lit(0.0))

    tp, pv, gv = F.col("tp"), F.col("pred_vox"), F.col("gt_vox")
    return out.select(
        *scope,
        pct(2 * tp, pv + gv).alias("dice"),
        pct(tp, pv + gv - tp).alias("iou"),
        pct(tp, pv).alias("precision"),
        pct(tp, gv).alias("recall"),
        "pred_vox",
        "gt_vox",
    )


def full_volume_dice(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Validation form: 2 tp / (pred + gt + 1e-8) per sample."""
    s = pred.select(*keys, *ZYX).withColumn("p", F.lit(1)).join(
        gt.select(*keys, *ZYX).withColumn("g", F.lit(1)), [*keys, *ZYX], "full"
    )
    agg = s.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col("p") * F.col("g"), F.lit(0))).alias("tp"),
        (F.count("p") + F.count("g")).alias("total"),
    )
    return agg.select(*keys, (2 * F.col("tp") / (F.col("total") + 1e-8)).alias("dice"))


def postprocess(probs: DataFrame, threshold: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """p > threshold -> largest 6-connected piece -> 3-D hole fill."""
    raw = binarize(probs, F.col("p") > threshold, keys)
    main = largest_component(components(raw, keys, 6), keys)
    return fill_holes3d(main.select(*keys, *ZYX), keys)


def erode_mask(mask: DataFrame, volumes: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return erode3d(mask, volumes, n, keys) if n > 0 else mask


def removal_stats(before: DataFrame, after: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Voxels removed by a step and their share of the stack and of the occupied voxels (x100)."""
    n0 = before.groupBy(*keys).agg(F.count("*").alias("n_before"))
    n1 = after.groupBy(*keys).agg(F.count("*").alias("n_after"))
    s = site_count(volumes, keys).join(n0, list(keys)).join(n1, list(keys), "left").na.fill(0, ["n_after"])
    gone = F.col("n_before") - F.col("n_after")
    return s.select(
        *keys, "n_before", "n_after", gone.alias("n_removed"), (gone * 100.0 / F.col("n_sites")).alias("pct_of_stack"),
        (gone * 100.0 / F.col("n_before")).alias("pct_of_occupied"),
    )
