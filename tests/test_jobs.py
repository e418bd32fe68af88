"""Composed jobs, outlines, crops and tiles on small volumes; registered queries against SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import dense_of
from voxtable.operators import crops as C, labels as L, outlines as O, sweeps as SW
from voxtable.plans import jobs as J
from voxtable.plans.tiles import tile_score


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["flagship_cells", "components_small_bricks", "splice", "create_labels", "postprocess", "normalize", "surface_area", "edt", "knn",
          "radius_count_3", "gap_contact", "match_objects", "recommend_merge", "clean_truncation", "image_slices", "voxel_sweep", "sieve",
          "recommend_all", "stream_monitor", "discover_files"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = sorted(repr(tuple(r)) for r in entry.queries()[name](spark, sf).select(*cols).collect())
    assert got == want and got


def test_outline_with_propagation(spark):
    square = [(2.0, 2.0), (2.0, 8.0), (8.0, 8.0), (8.0, 2.0)]
    small = [(4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0)]
    rows = [("f", 0, square), ("f", 4, small[::-1]), ("f", 9, small), ("g", 2, square), ("g", 5, square)]
    poly = spark.createDataFrame(rows, "fish_id string, z int, pts array<struct<y:double,x:double>>")
    dims = spark.createDataFrame([("f", 12, 10, 10), ("g", 8, 10, 10)], "fish_id string, nz int, ny int, nx int")
    got = {(r["fish_id"], r["z"]): r["pts"] for r in O.interpolate_outlines(poly, dims, propagate_from=4).collect()}
    assert len(got) == 20 and all(len(p) == 96 for p in got.values())
    # f has slice 4 as a key: slices 5-8 and 10-11 copy it, 9 keeps its own.
    assert got[("f", 6)] == got[("f", 4)] == got[("f", 11)] and got[("f", 9)] != got[("f", 4)]
    mid = np.array([(p["y"], p["x"]) for p in got[("f", 2)]])
    a, b = (np.array([(p["y"], p["x"]) for p in got[("f", z)]]) for z in (0, 4))
    assert np.allclose(mid, (a + b) / 2)
    # g has no slice 4: ends are copied.
    assert got[("g", 0)] == got[("g", 2)] and got[("g", 7)] == got[("g", 5)]
    # A loop around an integer square covers its half-open inside.
    assert O.rasterize(poly.filter("fish_id = 'g' and z = 2"), dims).count() == 36


def test_stretch_follows_the_index_rule(spark, make, dims):
    d = np.zeros((4, 1, 2), dtype=int)
    d[:, 0, 0] = [10, 20, 30, 40]
    v = dims({"f": d}).withColumn("anisotropy", F.lit(2.5))
    rows = make({"f": d}).join(v.select("fish_id", "nz", "anisotropy"), "fish_id")
    near = [r["label"] for r in C.stretch_z(rows, 0, "label", ["fish_id", "y", "x"]).orderBy("z").collect()]
    src = np.arange(10) * 3 / 9
    assert near == [[10, 20, 30, 40][int(np.floor(s + 0.5))] for s in src]
    flat = rows.withColumn("v", F.col("label").cast("double"))
    blend = [r["v"] for r in C.stretch_z(flat, 1, "v", ["fish_id", "y", "x"]).orderBy("z").collect()]
    assert np.allclose(blend, np.interp(src, range(4), [10, 20, 30, 40]))


def test_crops_obey_their_limits(make, dims):
    rng = np.random.default_rng(0)
    d = (rng.random((6, 40, 40)) < 0.05).astype(int) * rng.integers(1, 9, (6, 40, 40))
    lab, v = make({"f": d}), dims({"f": d})
    slices = C.label_slices(lab, v)
    crops = C.sample_crops(slices, C.slice_shapes(v), 16, 3, 8, 5).collect()
    assert crops and {r["orientation"] for r in crops} == {"xy"}  # the z-side is smaller than the crop
    assert len(crops) == 8 and max(r["crop_no"] for r in crops) <= 2
    for r in crops:
        px = d[r["slice_idx"], r["top"]:r["top"] + 16, r["left"]:r["left"] + 16]
        assert (px > 0).sum() == r["gt_px"] >= 5
        assert 0 <= r["top"] <= 24 and 0 <= r["left"] <= 24
    assert len({(r["slice_idx"], r["top"], r["left"]) for r in crops}) == len(crops)


def test_truncation_rule(spark):
    px = spark.createDataFrame(
        [("f", "xy", 0, 0, 0, i, 1) for i in range(9)] + [("f", "xy", 0, 0, 1, i, 2) for i in range(8)] + [("f", "xy", 0, 0, 2, 0, 3)],
        "fish_id string, orientation string, slice_idx int, crop_no int, y int, x int, label int",
    )
    full = spark.createDataFrame(
        [("f", "xy", 0, 0, i, 1) for i in range(10)] + [("f", "xy", 0, 1, i, 2) for i in range(10)],
        "fish_id string, orientation string, slice_idx int, y int, x int, label int",
    )
    kept, summary = C.clean_truncation(px, full)
    assert {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()} == {1: 9, 3: 1}
    assert tuple(summary.first())[1:] == (1, 1, 1)
    assert {r["label"] for r in C.clean_crops(kept).collect()} == {1}


def test_tiles_blend_and_cover_empty_space(spark, dims):
    d = np.zeros((5, 9, 9))
    v = spark.createDataFrame([("f", 2, 4, 4, 1.0)], "fish_id string, z int, y int, x int, norm double")
    p = tile_score(v, dims({"f": d}), lambda t: t * 4.0 - 2.0, (4, 4, 4), 0.5)
    got = {(r["z"], r["y"], r["x"]): r["p"] for r in p.collect()}
    assert len(got) == d.size
    assert got[(2, 4, 4)] == pytest.approx(1 / (1 + np.exp(-2))) and got[(0, 0, 0)] == pytest.approx(1 / (1 + np.exp(2)))


def test_sweep_over_one_point_equals_direct_run(spark, make, dims):
    rng = np.random.default_rng(1)
    d = rng.integers(0, 100, (6, 14, 14)) * (rng.random((6, 14, 14)) < 0.7)
    gt = (d > 40).astype(int)
    v = make({"f": d}, "value").withColumn("value", F.col("value").cast("double"))
    dim = dims({"f": d})
    g = L.relabel_by_volume(make({"f": gt}))
    cells = spark.createDataFrame([("f", 1)], "fish_id string, label int")
    r, avg, best = J.sigma_sweep(v.filter("value > 30"), g, dim, cells, [0.5], [0.4], 5, 3, pad_z=20, pad_xy=20)
    direct = L.create_labels(v.filter("value > 30"), dim, 0.5, 0.4, 5, 3)
    from voxtable.operators.scoring import best_match

    want = best_match(direct, g).filter("gt = 1").first()
    assert r.first()["iou"] == pytest.approx(want["iou"]) and best.first()["p1"] == 0.5


def test_sizes_per_sample_equal_single_runs(spark, make, dims):
    rng = np.random.default_rng(5)
    vols = {f: np.kron(rng.random((3, 6, 6)) < 0.45, np.ones((2, 3, 3))).astype(int) for f in "ab"}
    vols["a"][1, 4:6, 4:6] = 0
    sizes = spark.createDataFrame([("a", 40.0, 3), ("b", 150.0, 9)], "fish_id string, min_volume double, min_hole_size int")
    both = L.create_labels(make(vols, "value"), dims(vols), 0.4, 0.4, sizes, sizes)
    got = {tuple(r) for r in both.select("fish_id", "z", "y", "x", "label").collect()}
    want = set()
    for f, low, hole in sizes.collect():
        one = {f: vols[f]}
        out = L.create_labels(make(one, "value"), dims(one), 0.4, 0.4, low, hole)
        want |= {tuple(r) for r in out.select("fish_id", "z", "y", "x", "label").collect()}
    assert got == want and {r[0] for r in got} == {"a", "b"}


def test_sweep_defaults_come_from_ground_truth(spark, make):
    d = np.zeros((3, 12, 30), dtype=int)
    d[1, 5, :11] = d[1, :11, 5] = 2
    d[1, 5, 14:24] = 1
    d[0, 0:6, 20:26] = 3
    d[0, 2:4, 22:25] = 0
    g = make({"f": d})
    assert tuple(J.sweep_sizes(g, None, None).first()) == ("f", 10, 6)
    assert tuple(J.sweep_sizes(g, 7.0, 4).first()) == ("f", 7.0, 4)
    assert [r["label"] for r in J.sweep_cells(g, None, (1, 1, 1), 1).collect()] == [2]
    one = spark.createDataFrame([("f", 3), ("f", 3)], "fish_id string, label int")
    assert [r["label"] for r in J.sweep_cells(g, one, (1, 1, 1), 1).collect()] == [3]
    with pytest.raises(ValueError, match="no labelled cell"):
        J.sweep_cells(g.filter("label > 9"), None, (1, 1, 1), 1)


def test_best_background_equals_the_removal_it_stands_for(spark, make, dims):
    from voxtable.operators.masks import remove_global

    rng = np.random.default_rng(6)
    vols = {f: rng.integers(0, 60, (3, 12, 12)) for f in "ab"}
    v = make(vols, "value").withColumn("value", F.col("value").cast("double"))
    mask = make({f: np.ones((3, 12, 12), dtype=int) for f in vols}).drop("label")
    best = spark.createDataFrame([("a", 20.0, 0.0), ("b", 5.0, 1.0)], "fish_id string, p1 double, p2 double")
    got = {tuple(r) for r in J.best_background(v, mask, dims(vols), best).select("fish_id", "z", "y", "x", "value").collect()}
    want = set()
    for f, tol, e in best.collect():
        one = remove_global(v.filter(F.col("fish_id") == f), mask, dims(vols), tol, int(e))
        want |= {tuple(r) for r in one.select("fish_id", "z", "y", "x", "value").collect()}
    assert got == want and {r[0] for r in got} == {"a", "b"}


def test_pipeline_never_adds_objects_and_keeps_voxels(spark, make, dims):
    rng = np.random.default_rng(8)
    d = np.kron(rng.integers(0, 12, (3, 4, 4)), np.ones((2, 3, 3), dtype=int))
    final, counts, _ = J.correct_labels(make({"f": d}), dims({"f": d}), 1.0, 2, 6, 10)
    n = {r["stage"]: r["n_labels"] for r in counts.collect()}
    assert n["raw"] >= n["gmm"] >= n["safe_merge"] >= n["large_contact"] >= n["final"]
    ids = sorted(r["label"] for r in final.select("label").distinct().collect())
    assert ids == list(range(1, len(ids) + 1))
    assert final.join(make({"f": d}), ["fish_id", "z", "y", "x"], "left_anti").count() == 0


def test_rerun_replaces_one_label(spark, make, dims):
    d = np.zeros((3, 10, 20), dtype=int)
    d[:, 2:6, 2:12] = 1
    d[:, 2:6, 13:18] = 2
    parts = np.zeros_like(d)
    parts[:, 2:6, 2:6] = 5
    parts[:, 2:6, 8:12] = 6
    parts[:, 8:10, 2:5] = 7  # touches nothing of label 1
    req = spark.createDataFrame([("f", 1)], "fish_id string, label int")
    dim = dims({"f": d})
    out, _ = J.rerun_object(make({"f": d}), req, make({"f": parts}), dim, dim, 1, 2, max_gap=0.5, min_contact=5, large_contact=99, gt_min=1)
    got = dense_of(out, d.shape)["f"]
    assert set(np.unique(got)) == {0, 2, 3, 4} and (got == 3).sum() == 48 and (got == 4).sum() == 48 and (got == 2).sum() == 60


def test_compute_stats_schema(spark, make, dims):
    d = np.zeros((4, 8, 8), dtype=int)
    d[0:2, 0:3, 0:3], d[2:4, 4:8, 5:8] = 1, 2
    scale = (1.0, 0.2, 0.2)
    t = J.compute_stats(make({"f": d}), dims({"f": d}, scale), scale)
    assert len(t.columns) == 47 and t.count() == 2  # fish_id + 45 measured columns + description
    r = t.filter("label = 1").first()
    assert (r["volume_vox"], r["extent"], r["solidity"], r["nearest_neighbor_label"]) == (18, 1.0, 1.0, 2)
    bounds = spark.createDataFrame([(20.0, None)], "min_floor double, max_ceiling double")
    flags = J.compute_stats(make({"f": d}), dims({"f": d}, scale), scale, bounds=bounds)
    assert {x["label"]: x["is_volume_outlier"] for x in flags.collect()} == {1: True, 2: False}


def test_mask_from_empty_outline_raises(spark):
    poly = spark.createDataFrame([("f", 0, [(1.1, 1.1), (1.2, 1.2), (1.3, 1.1)]), ("f", 2, [(1.1, 1.1), (1.2, 1.2), (1.3, 1.1)])], "fish_id string, z int, pts array<struct<y:double,x:double>>")
    dims_ = spark.createDataFrame([("f", 3, 5, 5)], "fish_id string, nz int, ny int, nx int")
    v = spark.createDataFrame([("f", 0, 0, 0, 1.0)], "fish_id string, z int, y int, x int, value double")
    with pytest.raises(ValueError):
        J.masks_from_outlines(poly, dims_, v)


def test_best_point_prefers_scored_points(spark):
    r = spark.createDataFrame([("f", 1.0, 0.0, 0, 9.0), ("f", 2.0, 0.0, 3, 1.0), ("g", 1.0, 0.0, 0, 2.0)], "fish_id string, p1 double, p2 double, tp int, score double")
    got = {x["fish_id"]: x["p1"] for x in SW.best_point(r, ["score"], needs_tp=True).collect()}
    assert got == {"f": 2.0, "g": 1.0}
