"""Operators look at everything they are given."""

import pytest
from pyspark.sql import functions as F

from voxtable.functions.describe import _capital
from voxtable.operators import crops as C, objects as OB


def test_second_row_of_bounds_is_an_error(spark):
    objs = spark.createDataFrame([("a", 1, 5), ("a", 2, 50)], "fish_id string, label int, volume_vox long")
    bounds = spark.createDataFrame([(10, 90), (1, 20)], "min_floor int, max_ceiling int")
    one = OB.flag_outliers(objs, bounds.limit(1)).collect()
    assert {r["label"]: r["is_volume_outlier"] for r in one} == {1: True, 2: False}
    assert not any(r["is_volume_outlier"] for r in OB.flag_outliers(objs, bounds.limit(0)).collect())
    with pytest.raises(Exception, match="more than one row of bounds"):
        OB.flag_outliers(objs, bounds).collect()


def test_crops_are_found_behind_many_failing_anchors(spark):
    sparse = [(y, x) for y in range(8, 64, 8) for x in range(8, 64, 8)]
    px = [("a", "xy", 0, y, x, 1) for y, x in [(0, 0), (0, 1), *sparse]]
    slices = spark.createDataFrame(px, "fish_id string, orientation string, slice_idx int, y int, x int, label int")
    shapes = spark.createDataFrame([("a", "xy", 70, 70)], "fish_id string, orientation string, h int, w int")
    got = C.sample_crops(slices, shapes, 4, 1, 10, 2, tries=1).collect()
    assert [(r["top"], r["left"], r["gt_px"]) for r in got] == [(0, 0, 2)]


def test_widths_of_the_sweeps_change_the_mask(spark, sf):
    """Every smoothing width a registered sweep tries takes sites away and leaves some: none gives the mask back or empties it."""
    from voxtable.operators.stencils import smooth_mask
    from voxtable.queries import base, calibrating as Q

    mask = base.occupied(spark, sf, 0.0).localCheckpoint()
    for a in Q.SIGMAS_XY:
        for b in Q.SIGMAS_Z:
            assert 0 < smooth_mask(mask, base.vol(spark, sf), a, b).count() < mask.count()


def test_suite_smooths_its_background_sweep(spark, make, dims):
    """The widths reach the background sweep, and what its best point reached stands in the history."""
    import numpy as np

    from voxtable.plans import jobs as J

    d = np.zeros((3, 12, 12), dtype=int)
    d[:, 2:7, 2:7] = 1
    d[1, 9, 9] = 2
    voxels = make({"f": d * 10}, "value").withColumn("value", F.col("value").cast("double"))
    ok = spark.createDataFrame([("f", True)], "fish_id string, verified boolean")
    now = F.lit("2024-01-01").cast("timestamp")

    def reached(width):
        history, _ = J.calibration_suite(
            make({"f": d}), dims({"f": d}), voxels, ok, now, (1.0, 1.0, 1.0), true_mask=make({"f": np.ones_like(d)}).drop("label"), tolerances=(0.0,),
            signal_erosions=(0,), sigma_xys=(width,), sigma_zs=(0.5,), sigma_xy=width, sigma_z=0.5,
        )
        return {r["config_key"]: r["score"] for r in history.collect()}

    narrow, wide = reached(0.3), reached(1.0)
    for key in ("bg_tolerance", "sigma_xy"):
        assert narrow[key] == 100 > wide[key] > 0
    assert narrow["min_volume_vox"] is None


def test_long_text_keeps_its_end(spark):
    n = (1 << 20) + 5
    assert spark.range(1).select(F.length(_capital(F.expr(f"repeat('a', {n})")))).first()[0] == n


def test_overlap_link_keeps_wide_labels_apart(spark):
    """Labels beyond 32 bits: (0, 2^32 + 5) and (1, 5) are different objects, and only stacked ones are linked."""
    from voxtable.operators.components import overlap_link

    wide = (1 << 32) + 5
    rows = [("f", 0, 0, 0, wide), ("f", 1, 9, 9, 5), ("f", 2, 9, 9, wide), ("f", 2, 0, 0, 7)]
    px = spark.createDataFrame(rows, "fish_id string, z int, y int, x int, label long")
    got = {(r.z, r.label): tuple(r.group) for r in overlap_link(px, 0.5).collect()}
    assert got == {(0, wide): (0, wide), (1, 5): (1, 5), (2, wide): (1, 5), (2, 7): (2, 7)}
