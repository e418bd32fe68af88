"""Plans that must hold at any size: what explode makes large is never sent to the driver."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row

from voxtable.bricks import as_words, from_words
from voxtable.operators import outlines as O
from voxtable.operators.stencils import erode2d
from voxtable.queries import QUERIES


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_touching_pairs_are_not_broadcast(make):
    from voxtable.operators.stencils import face_pairs

    assert "BroadcastHashJoin" not in final_plan(face_pairs(make({"f": np.arange(1, 9).reshape(2, 2, 2)})))


@pytest.mark.parametrize("name", ["apply_mask", "invert_mask", "skin_mask", "mask_and"])
def test_masks_are_not_broadcast(spark, sf, name):
    assert "BroadcastHashJoin" not in final_plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["erode2d_1", "erode3d_1"])
def test_rows_of_a_sample_are_not_broadcast(spark, sf, name):
    """Neither the words of a mask nor voxels travel to meet the one row of their sample."""
    assert "BroadcastHashJoin" not in final_plan(QUERIES[name](spark, sf)).split("== Initial Plan ==")[0]


def test_packed_tables_are_not_broadcast(spark):
    """A regular mask of two million sites fits a small file and a small shuffle; its rows do not fit the driver."""
    from pyspark.sql import functions as F

    from voxtable.session import materialize

    sites = spark.range(1 << 21).select(*[F.pmod(F.shiftright("id", s), F.lit(128)).cast("int").alias(c) for c, s in (("z", 14), ("y", 7), ("x", 0))])
    mask = materialize(sites, "packed")
    assert "BroadcastHashJoin" not in final_plan(spark.range(8).select(F.col("id").cast("int").alias("x")).join(mask, "x", "left").groupBy("x").agg(F.max("z"), F.max("y")))


@pytest.mark.parametrize("name", ["align_direction", "interpolate_outlines", "rasterize"])
def test_outlines_are_neither_broadcast_nor_shuffled_after_resampling(spark, sf, name):
    plan = final_plan(QUERIES[name](spark, sf)).split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def test_outline_that_stands_for_later_slices(spark):
    def square(r):
        return [Row(y=5.0 + a * r, x=5.0 + b * r) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))]

    rows = [("a", z, square(float(r))) for z, r in ((1, 1), (4, 2), (8, 3))]
    polygons = spark.createDataFrame(rows, "fish_id string, z int, pts array<struct<y:double,x:double>>")
    volumes = spark.createDataFrame([("a", 10)], "fish_id string, nz int")

    def radius(stop):
        out = O.interpolate_outlines(polygons, volumes, ["fish_id"], stop, 8).collect()
        got = sorted((r["z"], round(5.0 - r["pts"][0]["y"], 6)) for r in out)
        assert [z for z, _ in got] == list(range(10))
        return [r for _, r in got]

    third = [round(1 + i / 3, 6) for i in (1, 2)]
    assert radius(None) == [1, 1, *third, 2, 2.25, 2.5, 2.75, 3, 3]
    assert radius(4) == [1, 1, *third, 2, 2, 2, 2, 3, 2]
    assert radius(5) == radius(None)


@pytest.mark.parametrize("brick", [(2, 3, 5), (4, 8, 33), (32, 128, 128)])
def test_masks_travel_as_words(spark, brick):
    """A full line of 70 sites is three rows on its way to the bricks; the result does not depend on the cut."""
    dims = spark.createDataFrame([("a", 3, 4, 70)], "fish_id string, nz int, ny int, nx int")
    sites = [("a", z, y, x) for z in range(3) for y in range(4) for x in range(70) if (z, y, x) != (1, 2, 40)]
    mask = spark.createDataFrame(sites, "fish_id string, z int, y int, x int")
    assert as_words(mask, ["fish_id"]).count() == 3 * 4 * 3
    assert sorted(map(tuple, from_words(as_words(mask, ["fish_id"]), ["fish_id"]).collect())) == sites
    full = set(sites)
    steps = [(0, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    want = sorted(s for s in sites if all(("a", s[1] + d[0], s[2] + d[1], s[3] + d[2]) in full for d in steps))
    assert sorted(map(tuple, erode2d(mask, dims, 1, ["fish_id"], brick=brick).collect())) == want


def test_outlines_become_masks_as_words(spark):
    """Raster, vote along z and both cuts on words of 32 sites: as site by site, and a mask's words are shuffled once for the vote."""
    from voxtable.operators import masks as M, stencils as S

    rng = np.random.default_rng(4)
    nz, ny, nx = 5, 12, 70
    shapes = {}
    for z in range(nz):
        at = np.sort(rng.uniform(0, 2 * np.pi, 9))
        r = rng.uniform(0.3, 1.3, 9)  # partly concave, partly outside the frame
        shapes[z] = [(float(6.013 + 6 * b * np.sin(a)), float(34.017 + 36 * b * np.cos(a))) for a, b in zip(at, r)]
    polygons = spark.createDataFrame([("a", z, p) for z, p in shapes.items()], "fish_id string, z int, pts array<struct<y:double,x:double>>")
    dims = spark.createDataFrame([("a", nz, ny, nx)], "fish_id string, nz int, ny int, nx int")
    dense = np.zeros((nz, ny, nx), dtype=bool)
    for z, p in shapes.items():
        for (y0, x0), (y1, x1) in zip(p, p[1:] + p[:1]):
            for y in range(ny):
                if min(y0, y1) <= y < max(y0, y1):
                    dense[z, y] ^= np.arange(nx) < x0 + (y - y0) * (x1 - x0) / (y1 - y0)

    def sites(df):
        return {(r["z"], r["y"], r["x"]) for r in df.collect()}

    def places(where):
        return {tuple(map(int, p)) for p in zip(*np.nonzero(where))}

    words = O.rasterize(polygons, dims, words=True)
    assert words.count() <= nz * ny * 3 < dense.sum()
    assert sites(from_words(words)) == sites(O.rasterize(polygons, dims)) == places(dense)
    padded = np.concatenate((dense[:1], dense, dense[-1:])).astype(int)
    voted = padded[:-2] + padded[1:-1] + padded[2:] >= 2
    mask = S.z_median3(words, dims)
    assert sites(from_words(mask)) == sites(S.z_median3(from_words(words), dims)) == places(voted)
    written = words.localCheckpoint()
    plan = final_plan(S.z_median3(written, dims)).split("== Initial Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 3  # the volumes twice (distinct, then dealt) and the words
    grid = spark.createDataFrame([("a", z, y, x, 1.0) for z, y, x in np.ndindex(nz, ny, nx)], "fish_id string, z int, y int, x int, value double")
    for m in (mask, from_words(mask)):
        assert sites(M.apply_mask(grid, m)) == places(voted) and sites(M.invert_mask(grid, m)) == places(~voted)
    assert M.apply_mask(grid, mask).columns == grid.columns


def test_neighbour_search_sends_no_point_to_27_cells(spark):
    """A long thin sample with a crowd: the same neighbours as by brute force, and few rows shuffled."""
    import numpy as np

    from voxtable.operators import pairs as P

    rng = np.random.default_rng(3)
    at = np.concatenate((rng.uniform(0, 1, (600, 3)) * (4, 300, 4), rng.uniform(0, 1, (80, 3)) + (0, 150, 0), [(0.0, 900.0, 0.0)]))
    rows = [("a", i, *map(float, p)) for i, p in enumerate(at)] + [("b", 0, 1.0, 1.0, 1.0), ("c", 0, 1.0, 1.0, 1.0), ("c", 1, 1.0, 9.0, 1.0)]
    points = spark.createDataFrame(rows, "fish_id string, label int, z double, y double, x double")
    got = {(r["fish_id"], r["label"], r["rank"]): (r["nn_label"], round(r["dist"], 9)) for r in P.knn(points, 2, ["fish_id"]).collect()}
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :2]
    want = {("a", i, r + 1): (int(j), round(float(d[i, j]), 9)) for i, two in enumerate(order) for r, j in enumerate(two)}
    assert got == want | {("c", 0, 1): (1, 8.0), ("c", 1, 1): (0, 8.0)}

    cells = points.select("*", *[P.F.floor(c).alias(f"h{c}") for c in "zyx"])
    assert P._in_blocks(cells, "h", True).count() < 8 * len(rows)
    assert P._in_blocks(cells, "h", False).count() == len(rows)


def test_branch_links_send_no_voxel_to_26_neighbours(spark):
    import numpy as np

    from voxtable.operators import shape as SH

    rng = np.random.default_rng(5)
    at = sorted({tuple(map(int, p)) for p in rng.integers(0, 18, (700, 3))})
    rows = [("a", 1 + (p[2] > 9), *p) for p in at]
    voxels = spark.createDataFrame(rows, "fish_id string, label int, z int, y int, x int")
    assert SH._meeting(voxels, ["fish_id", "label"])[1].count() < 3 * len(rows)

    near = {(r[2:], q[2:]) for r in rows for q in rows if r != q and r[1] == q[1] and max(abs(a - b) for a, b in zip(r[2:], q[2:])) <= 1}
    degree = {p: sum(1 for a, _ in near if a == p) for p, _ in near}
    want = {(a, b, degree[b] > 2) for a, b in near if degree[a] <= 2}
    chain, links = SH.branch_voxels(voxels, ["fish_id"])
    assert {(r["z"], r["y"], r["x"]): r["degree"] for r in chain.collect()} == {p: n for p, n in degree.items() if n <= 2}
    assert {((r["z_a"], r["y_a"], r["x_a"]), (r["z"], r["y"], r["x"]), r["to_junction"]) for r in links.collect()} == want


def test_value_counts_stay_where_they_are(spark, sf, monkeypatch):
    """The ends of the value range are written first, so that Spark knows them for the small side."""
    from voxtable.operators import masks as M

    tags, write = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, tag="stage": tags.append(tag) or write(df, tag))
    plan = final_plan(QUERIES["background_mode"](spark, sf)).split("== Initial Plan ==")[0]
    assert "BuildLeft" not in plan and tags == ["values", "ends"]


def test_safe_replay_looks_near_a_fragment_only():
    """The work of a group grows with its objects: a visit looks at the boxes around it, a merge at its neighbours' sets."""
    from voxtable.operators import merging as MG

    n = 30_000
    y = np.arange(n) * 6
    objs = pd.DataFrame({"label": np.arange(1, n + 1), "volume_vox": 1 + np.arange(n) % 7, "cz": 0.0, "cy": y + 0.0, "cx": 0.0,
                         "z0": 0, "y0": y, "x0": 0, "z1": 1, "y1": y + 1, "x1": 1, "margin": 8.0})
    near = {(i, i + 1) for i in range(1, n)}
    ring = list(range(1, n)), list(range(2, n + 1))
    touch = MG._Touch(ring[0] + ring[1], ring[1] + ring[0], list(range(2 * n - 2)))
    start = time.perf_counter()
    out = dict(MG._replay_safe(objs, near, touch, 1.0, 1, 7))
    assert time.perf_counter() - start < 15  # 30,000 objects; each visit of all of them took minutes
    assert len(out) == n and len(set(out.values())) < n
    volume = objs.groupby(objs["label"].map(out))["volume_vox"].sum()
    assert volume.sum() == objs["volume_vox"].sum() and (volume >= 7).all()


def test_density_halves_crowded_cells(spark, monkeypatch):
    """Cut pairs of crowded cells are halved, and lists are dealt in parts; counts stay those of all pairs."""
    from voxtable.operators import pairs as P

    monkeypatch.setattr(P, "FEW", 64)
    monkeypatch.setattr(P, "LISTED", 4)
    rng = np.random.default_rng(3)
    p = np.round(np.vstack([rng.random((250, 3)) * (3, 40, 2), np.full((30, 3), 1.25), [[900.0, 0.0, 0.0]]]), 2)
    df = spark.createDataFrame(pd.DataFrame({"fish_id": "f", "label": np.arange(len(p)), "z": p[:, 0], "y": p[:, 1], "x": p[:, 2]}))
    got = {r["label"]: r["n_within"] for r in P.radius_count(df, 10.0).collect()}
    d = p[:, None] - p[None]
    want = (np.sqrt(d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2) <= 10.0).sum(axis=1) - 1
    assert got == dict(enumerate(want.tolist()))


def test_late_lines_change_a_block_once_a_batch():
    """Lines dealt by a hash reach every block in every Arrow batch; each block is written once, not once a batch."""
    from voxtable.streaming.metrics import _Monitor

    class Store(dict):
        written = 0

        def containsKey(self, at):
            return at in self

        def getValue(self, at):
            return self[at]

        def updateValue(self, at, value):
            self.written += 1
            self[at] = value

        def iterator(self):
            return iter(self.items())

    class Handle:
        def getMapState(self, name, *_):
            return Store()

    rng = np.random.default_rng(4)
    n = 2000
    value = rng.integers(5, 900, n) / 100
    frame = pd.DataFrame({"seq": np.arange(1, n + 1), "epoch": np.arange(1, n + 1), "value": value})
    m = _Monitor(500, -1.0, 100)
    m.init(Handle())
    order = rng.permutation(n)
    for half in (order[:900], order[900:]):
        m.lines.written = 0
        (out,) = m.handleInputRows(("a",), (frame.iloc[half[i : i + 50]] for i in range(0, len(half), 50)), None)
        assert m.lines.written == len(m.blocks)
    at = int(np.argmin(value))
    assert list(out.iloc[0]) == ["a", n, value[at], at + 1, n - 1 - at, n - 1 - at >= 500]


def test_holes_of_all_labels_of_a_slice_are_searched_together(spark, monkeypatch):
    """Holes per label are those of each label alone, however many boxes are searched at once; 60,000 rings take no loop."""
    from voxtable.operators import stencils as S

    rng = np.random.default_rng(2)
    at = np.unique(rng.integers(0, 16, (330, 2)), axis=0)
    rows = [("a", 0, int(y), int(x), int(k)) for (y, x), k in zip(at, rng.choice([3, 7, 11], len(at), p=[0.7, 0.2, 0.1]))]
    rows += [("a", 1, y, x, 7) for y in range(5) for x in range(6) if (y, x) not in ((1, 1), (2, 2), (2, 3), (3, 4))]
    labels = spark.createDataFrame(rows, "fish_id string, z int, y int, x int, label int")
    want = set()
    for z, k in {(r[1], r[4]) for r in rows}:
        own = {r[2:4] for r in rows if (r[1], r[4]) == (z, k)}
        open_ = {(y, x) for y in range(-1, 17) for x in range(-1, 17)} - own
        while open_:
            piece, edge = set(), [min(open_)]
            while edge:
                y, x = edge.pop()
                if (y, x) in open_:
                    open_.remove((y, x))
                    piece.add((y, x))
                    edge += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            if (-1, -1) not in piece:
                want |= {(z, k, y, x, len(piece)) for y, x in piece}
    for sites in (1, 200, 1 << 22):
        monkeypatch.setattr(S, "SITES", sites)
        got = {(r["z"], r["label"], r["y"], r["x"], r["hole_size"]) for r in S.slice_holes(labels, ["fish_id"], ["label"]).collect()}
        assert got == want and len(want) > 5

    n = 60_000
    ring = np.array([(y, x) for y in range(3) for x in range(3) if (y, x) != (1, 1)])
    y, x = (ring[None] + np.stack((np.arange(n) * 4, np.zeros(n, int)), 1)[:, None]).reshape(-1, 2).T
    start = time.perf_counter()
    group, ys, xs, hole, size = S._slice_holes(y, x, np.repeat(np.arange(n), 8))
    assert time.perf_counter() - start < 10  # one by one they took a minute
    assert (group == np.arange(n)).all() and (ys == np.arange(n) * 4 + 1).all() and (xs == 1).all() and (hole == 1).all() and (size == 1).all()


def test_objects_whose_partners_are_alone_need_no_block(spark, monkeypatch):
    """Fragments inside one cell, and cells under one object, keep the best pair by an aggregation; only mixed blocks are solved."""
    from voxtable.operators import scoring as SC

    pairs = [(1, 1, 0.2), (1, 2, 0.5), (1, 3, 0.5), (2, 4, 0.3), (3, 4, 0.3), (4, 5, 0.9), (5, 6, 0.6), (5, 7, 0.5), (6, 6, 0.5)]
    edges = spark.createDataFrame([("a", g, p, s) for g, p, s in pairs], "fish_id string, gt int, pred int, iou double")
    seen, connected = [], SC.connected
    monkeypatch.setattr(SC, "connected", lambda e, keys: seen.append(e.count()) or connected(e, keys))
    got = {(r["gt"], r["pred"], r["iou"]) for r in SC.assign(edges, ["fish_id"]).collect()}
    assert got == {(1, 2, 0.5), (2, 4, 0.3), (4, 5, 0.9), (5, 7, 0.5), (6, 6, 0.5)} and seen == [3]


def test_limits_found_before_are_not_measured_again(spark, monkeypatch):
    """A suite measures size bounds and holes once; its sweeps take the table."""
    from voxtable.plans import jobs as J

    d = [("f", 0, y, x, 1) for y in range(4) for x in range(5) if (y, x) not in ((1, 1), (2, 3))]
    gt = spark.createDataFrame(d, "fish_id string, z int, y int, x int, label int")
    limits = J.size_limits(gt)
    want = J.sweep_sizes(gt, None, None).collect()
    monkeypatch.setattr(J, "slice_holes", None)
    monkeypatch.setattr(J, "size_bounds", None)
    assert J.sweep_sizes(gt, limits, limits).collect() == want
