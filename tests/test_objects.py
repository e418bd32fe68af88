"""Shapes, matching, merging and splitting against brute force on small volumes."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import dense_of
from voxtable.functions.scalar import to_um
from voxtable.operators import merging as MG, objects as OB, pairs as P, scoring as SR, shape as SH, splitting as SP, sweeps as SW

SCALE = (1.0, 0.174, 0.174)


def test_single_cube_bar(make, dims):
    one = np.zeros((3, 3, 3), dtype=int)
    one[1, 1, 1] = 1
    cube = np.zeros((4, 4, 4), dtype=int)
    cube[1:3, 1:3, 1:3] = 1
    bar = np.zeros((3, 3, 12), dtype=int)
    bar[1, 1, 1:11] = 1
    lab = make({"one": one, "cube": cube, "bar": bar})
    p = {r["fish_id"]: r for r in OB.principal_axes(OB.regionprops(lab)).collect()}
    assert p["one"]["volume_vox"] == 1 and (p["one"]["z0"], p["one"]["z1"]) == (1, 2) and p["one"]["extent"] == 1
    assert p["cube"]["cz"] == 1.5 and p["cube"]["extent"] == 1
    assert p["bar"]["principal_axis_dir"] == "X" and p["one"]["principal_axis_dir"] == "Z"
    assert p["bar"]["axis_minor"] == 0 and p["bar"]["axis_major"] == pytest.approx(np.sqrt(20 * 99 / 12))
    s = {r["fish_id"]: r["solidity"] for r in SH.solidity(lab).collect()}
    assert s == {"one": 1.0, "cube": 1.0, "bar": 1.0}
    um = to_um(OB.object_info(lab), dims({"one": one, "cube": cube, "bar": bar}, SCALE)).filter("fish_id = 'bar'").first()
    assert um["bbox_dx_um"] == 1.74 and um["volume_um3"] == 0.3


@pytest.mark.parametrize("seed", range(4))
def test_principal_axes_match_eigh(make, seed):
    rng = np.random.default_rng(seed)
    d = (rng.random((6, 7, 9)) < 0.2).astype(int)
    r = OB.principal_axes(OB.regionprops(make({"f": d}))).first()
    c = np.argwhere(d).astype(float)
    v = np.cov(c.T, bias=True)
    tensor = np.trace(v) * np.eye(3) - v
    ev, vec = np.linalg.eigh(tensor)
    l3, l2, l1 = ev
    assert r["axis_major"] == pytest.approx(np.sqrt(10 * (l1 + l2 - l3)))
    assert r["axis_minor"] == pytest.approx(np.sqrt(10 * (l2 + l3 - l1)))
    assert r["principal_axis_dir"] == "ZYX"[int(np.argmax(np.abs(vec[:, 0])))]


def test_surface_area_shapes(make):
    assert SH.cell_areas(1, 1, 1)[0] == SH.cell_areas(1, 1, 1)[255] == 0
    # A single voxel is an octahedron with half-axes 0.5: eight triangles of side sqrt(0.5).
    one = np.zeros((1, 1, 1), dtype=int) + 1
    cube = np.ones((4, 4, 4), dtype=int)
    got = {r["fish_id"]: r["surface_area_um2"] for r in SH.surface_area(make({"one": one, "cube": cube}), (1, 1, 1)).collect()}
    assert got["one"] == pytest.approx(8 * np.sqrt(3) / 4 * 0.5)
    # Flat faces 6 * 3 * 3, bevelled edges 12 * 3 * sqrt(0.5), corners one octant each.
    assert got["cube"] == pytest.approx(54 + 36 * np.sqrt(0.5) + np.sqrt(3))
    # Complementary codes bound the same surface unless a face is ambiguous.
    a = SH.cell_areas(1.0, 0.5, 0.25)
    assert a[1] == pytest.approx(a[254]) and a[3] == pytest.approx(a[252])


def brute_hull_count(v):
    """Sites that are convex combinations: tested by separating planes through point triples of the armed set."""
    pts = SH._armed(*np.asarray(v).T)
    pts = np.unique(pts, axis=0)
    planes = []
    for i, j, k in itertools.combinations(range(len(pts)), 3):
        n = np.cross(pts[j] - pts[i], pts[k] - pts[i])
        if not n.any():
            continue
        side = (pts - pts[i]) @ n
        if (side <= 0).all():
            planes.append((n, n @ pts[i]))
        elif (side >= 0).all():
            planes.append((-n, -(n @ pts[i])))
    lo, hi = np.min(v, axis=0), np.max(v, axis=0)
    grid = itertools.product(*[range(a, b + 1) for a, b in zip(lo, hi)])
    return sum(all(np.dot(n, np.array(g) * 2) <= d for n, d in planes) for g in grid)


@pytest.mark.parametrize("seed", range(5))
def test_solidity_matches_brute_force(make, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    d = np.zeros((5, 5, 5), dtype=int)
    d[tuple(rng.integers(0, 5, (3, 6)))] = 1
    want = d.sum() / brute_hull_count(np.argwhere(d).tolist())
    assert SH.solidity(make({"f": d})).first()["solidity"] == pytest.approx(want)
    monkeypatch.setattr(SH, "SMALL_ROWS", 0)
    assert SH.solidity(make({"f": d})).first()["solidity"] == pytest.approx(want)
    monkeypatch.setattr(SH, "HULL_ROWS", 1)
    assert SH.solidity(make({"f": d}), block=2).first()["solidity"] == pytest.approx(want)


def stats_of(make, volumes, **kw):
    lab = make(volumes)
    return {r["fish_id"]: r for r in SH.branch_stats(SH.skeleton_branches(lab, **kw), lab).collect()}


def test_branches_of_simple_shapes(make):
    rod = np.zeros((3, 3, 12), dtype=int)
    rod[1, 1, 1:11] = 1
    ell = np.zeros((1, 10, 10), dtype=int)
    ell[0, 0, :] = ell[0, :, 0] = 1
    plus = np.zeros((1, 11, 11), dtype=int)
    plus[0, 5, :] = plus[0, :, 5] = 1
    tee = np.zeros((1, 8, 11), dtype=int)
    tee[0, 0, :] = tee[0, :, 5] = 1
    dot = np.ones((1, 1, 1), dtype=int)
    got = stats_of(make, {"rod": rod, "ell": ell, "plus": plus, "tee": tee, "dot": dot})
    n = {k: (r["n_branches"], r["n_endpoints"]) for k, r in got.items()}
    assert n == {"rod": (1, 0), "ell": (1, 0), "plus": (4, 4), "tee": (3, 3), "dot": (0, 0)}
    assert got["rod"]["max_branch_len_um"] == 9 and got["rod"]["branch_tortuosity"] == 1
    assert got["ell"]["branch_tortuosity"] > 1.2 and got["dot"]["branch_tortuosity"] == 1


def test_thinning_keeps_topology_and_ignores_bricks(make):
    thick = np.zeros((12, 30, 30), dtype=int)
    thick[3:9, 5:25, 5:11] = 1
    thick[3:9, 5:25, 19:25] = 1
    thick[3:9, 5:11, 5:25] = 1
    thick[3:9, 19:25, 5:25] = 1  # a square tube ring: one hole
    lab = make({"ring": thick})
    whole = sorted(map(tuple, SH.skeletonize(lab).collect()))
    cut = sorted(map(tuple, SH.skeletonize(lab, brick=(4, 8, 8)).collect()))
    assert whole == cut and 0 < len(whole) < 100
    br = SH.skeleton_branches(lab).collect()
    assert len(br) == 1 and br[0]["branch_type"] == 3


def test_edt_of_ball_and_branch_radius(make):
    g = np.indices((9, 9, 9)) - 4
    ball = ((g**2).sum(axis=0) <= 9).astype(int)
    got = dense_of(SH.edt(make({"b": ball}), (1, 1, 1)).withColumn("d", F.round(F.col("dist_um") * 1000).cast("int")), ball.shape, "d")["b"]
    bg = np.argwhere(ball == 0)
    for v in np.argwhere(ball):
        assert got[tuple(v)] == round(np.sqrt(((bg - v) ** 2).sum(axis=1).min()) * 1000)
    tube = np.zeros((7, 7, 30), dtype=int)
    tube[2:5, 2:5, 2:28] = 1
    d = SH.branch_diameters(make({"t": tube}), (1, 1, 1))
    r = SH.recommend_branch_radius(d, 1.0).first()
    assert d.count() == 1 and r["branch_radius_px"] == 2


def test_gap_depends_on_axis(make, dims):
    rows = {}
    for n in (1, 2, 3):
        for axis in (0, 2):
            d = np.zeros((10, 4, 10), dtype=int)
            a = [slice(0, 2)] * 3
            b = list(a)
            b[axis] = slice(2 + n - 1, 4 + n - 1)
            d[tuple(a)], d[tuple(b)] = 1, 2
            rows[f"{n}{axis}"] = d
    pairs = make(rows).select("fish_id").distinct().withColumn("a", F.lit(1)).withColumn("b", F.lit(2))
    got = {r["fish_id"]: r for r in P.gap_contact(make(rows), pairs, dims(rows, SCALE)).collect()}
    for n in (1, 2, 3):
        assert got[f"{n}2"]["gap_um"] == pytest.approx(0.174 * n)
        assert got[f"{n}0"]["gap_um"] == pytest.approx(1.0 * n)
    assert got["12"]["contact_vox"] == 4 and got["22"]["contact_vox"] == 0
    g = P.min_intercell_gap(make(rows), dims(rows, SCALE)).filter("fish_id = '12'").first()
    assert (g["label_a"], g["label_b"], g["n_pairs_measured"]) == (1, 2, 1) and g["min_gap_um"] == pytest.approx(0.174)


def test_gap_beyond_the_pad_counts_only_the_box(make, dims):
    d = np.zeros((1, 14, 14), dtype=int)
    d[0, 0, 0] = 1
    d[0, 3, 3] = 2  # inside the box padded by 3, distance sqrt(18)
    d[0, 0:4, 4] = 2  # outside that box, nearer: distance 4
    got = P.intercell_gaps(make({"f": d}), dims({"f": d}), 3.0).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2)] and got[0]["gap_um"] == pytest.approx(np.sqrt(18))


def test_knn_with_a_crowd_and_lone_points(spark):
    rng = np.random.default_rng(2)
    pts = {"crowd": np.vstack([rng.normal(0, 0.01, (150, 3)), rng.uniform(0, 100, (50, 3))]).round(3), "two": np.array([[0, 0, 0], [1, 1, 1.0]]), "one": np.zeros((1, 3))}
    rows = [(f, i + 1, *map(float, p)) for f, a in pts.items() for i, p in enumerate(a)]
    df = spark.createDataFrame(rows, "fish_id string, label int, z double, y double, x double")
    got = {(r["fish_id"], r["label"]): r for r in P.nearest_two(df).collect()}
    a = pts["crowd"]
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(a)):
        order = np.lexsort((np.arange(len(a)), d[i]))
        r = got[("crowd", i + 1)]
        assert r["nearest_neighbor_dist_um"] == pytest.approx(d[i, order[0]])
        assert r["nearest_neighbor_2_dist_um"] == pytest.approx(d[i, order[1]])
    assert got[("two", 1)]["nearest_neighbor_2_label"] == 2
    assert got[("one", 1)]["nearest_neighbor_label"] == 1 and got[("one", 1)]["nearest_neighbor_dist_um"] == 0
    n = {(r["fish_id"], r["label"]): r["n_within"] for r in P.radius_count(df, 20.0).collect()}
    assert all(n[("crowd", i + 1)] == int((d[i] <= 20).sum()) for i in range(len(a)))


def test_assignment_beats_threshold_filter(make):
    g = np.zeros((1, 1, 200), dtype=int)
    p = np.zeros((1, 1, 200), dtype=int)
    g[0, 0, 0:40] = 1  # g1: 27 shared with p1, 13 with p2
    p[0, 0, 0:13] = 2
    p[0, 0, 100:103] = 2  # p2 has 16 voxels
    p[0, 0, 13:40] = 1
    p[0, 0, 40:53] = 1  # p1 has 40, 13 of them in g2
    g[0, 0, 40:53] = 2
    g[0, 0, 110:113] = 2  # g2 has 16
    pairs = SR.assign(SR.iou_edges(make({"f": p}), make({"f": g}))).collect()
    assert sorted((r["gt"], r["pred"]) for r in pairs) == [(1, 2), (2, 1)]
    assert SR.score_against_gt(make({"f": p}), make({"f": g}), 0.5).first()["tp"] == 0


@pytest.mark.parametrize("seed", range(20))
def test_best_assignment_matches_permutations(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    s = np.where(rng.random((n, m)) < 0.5, 0, rng.random((n, m)).round(2))
    got = sum(s[r, c] for r, c in SR.best_assignment(s))
    big = s if n <= m else s.T
    want = max(sum(big[i, p[i]] for i in range(big.shape[0])) for p in itertools.permutations(range(big.shape[1]), big.shape[0]))
    assert got == pytest.approx(want)


def test_worked_scores_and_role_swap(make):
    assert SR.score_counts(34, 8, 5) == 27.5 and SR.score_counts(10, 28, 18) == -13.0
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 6, (3, 8, 8)), rng.integers(0, 6, (3, 8, 8))
    one = SR.score_against_gt(make({"f": a}), make({"f": b}), 0.1).first()
    two = SR.score_against_gt(make({"f": b}), make({"f": a}), 0.1).first()
    assert one["tp"] == two["tp"] and one["fp"] == two["fn"]


def brute_recommend(yes, no):
    gaps = sorted({g for g, _ in yes + no} | {min(g for g, _ in yes + no) - 1})
    cons = sorted({c for _, c in yes + no} | {max(c for _, c in yes + no) + 1})
    best = None
    for g in gaps:
        for c in cons:
            missed = sum(a > g and b < c for a, b in yes)
            false = sum(not (a > g and b < c) for a, b in no)
            if best is None or missed + false < best[0]:
                best = (missed + false, g, c, missed, false)
    return best[1:]


def test_recommend_merge_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for f in "abc":
        yes = [(float(rng.integers(1, 9)), int(rng.integers(0, 6))) for _ in range(25)]
        no = [(float(rng.integers(3, 14)), int(rng.integers(0, 4))) for _ in range(25)]
        rows += [(f, "should_merge", *s) for s in yes] + [(f, "should_not_merge", *s) for s in no]
        want[f] = brute_recommend(yes, no)
    df = spark.createDataFrame(rows, "fish_id string, kind string, gap_um double, contact_vox int")
    for r in SR.recommend_merge(df).collect():
        assert (r["max_gap_um"], r["contact_vox"], r["missed_merges"], r["false_merges"]) == want[r["fish_id"]]


# --- merging replayed on dense arrays -------------------------------------------


def info_of(d):
    out = {}
    for i in np.unique(d[d > 0]):
        v = np.argwhere(d == i)
        out[int(i)] = [len(v), v.mean(axis=0), v.min(axis=0), v.max(axis=0) + 1]
    return out


def near_boxes(a, b, m):
    return all(not (a[3][k] + m < b[2][k] or b[3][k] + m < a[2][k]) for k in range(3))


def touching(d, f, t):
    mine = {tuple(v) for v in np.argwhere(d == f)}
    n = 0
    for v in np.argwhere(d == t):
        n += any(tuple(v + s * np.eye(3, dtype=int)[k]) in mine for k in range(3) for s in (1, -1))
    return n


def gap(d, f, t, scale):
    a, b = np.argwhere(d == f) * scale, np.argwhere(d == t) * scale
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min()


def brute_safe(d, max_gap, min_contact, gt_min, scale):
    d = d.copy()
    for _ in range(200):
        info, any_ = info_of(d), False
        for f in sorted((i for i in info if info[i][0] < gt_min), key=lambda i: info[i][0]):
            if f not in info:
                continue
            best = None
            for t in info:
                if t == f or info[t][0] <= info[f][0] or not near_boxes(info[f], info[t], max_gap / min(scale) + 2):
                    continue
                away = np.linalg.norm(info[t][1] - info[f][1])
                if best is None or away < best[0] - 1e-12:
                    best = (away, t)
            if best is None:
                continue
            t = best[1]
            if gap(d, f, t, np.array(scale)) <= max_gap + 1e-12 or touching(d, f, t) >= min_contact:
                d[d == f] = t
                del info[f]
                info[t] = info_of(np.where(d == t, t, 0))[t]
                any_ = True
        if not any_:
            return d
    return d


def brute_contact(d, threshold):
    d = d.copy()
    for _ in range(50):
        info, any_ = info_of(d), False
        for f in sorted(info, key=lambda i: info[i][0]):
            if f not in info:
                continue
            for t in list(info):
                if t == f or t not in info or touching(d, f, t) < threshold:
                    continue
                keep, drop = (t, f) if info[t][0] >= info[f][0] else (f, t)
                d[d == drop] = keep
                del info[drop]
                info[keep] = info_of(np.where(d == keep, keep, 0))[keep]
                any_ = True
                break
        if not any_:
            return d
    return d


def fragments(seed, shape=(5, 12, 14), n=16):
    rng = np.random.default_rng(seed)
    d = np.zeros(shape, dtype=int)
    for i in range(1, n + 1):
        lo = [int(rng.integers(0, s - 1)) for s in shape]
        hi = [a + int(rng.integers(1, 4)) for a in lo]
        box = d[tuple(slice(a, b) for a, b in zip(lo, hi))]
        box[box == 0] = i
    return d


def test_safe_merge_matches_dense_replay(make, dims):
    scale = (1.3, 0.7, 0.6)
    vols = {f"s{i}": fragments(i) for i in range(5)}
    got = dense_of(MG.safe_merge(make(vols), dims(vols, scale), 0.75, 3, 12), (5, 12, 14))
    for f, d in vols.items():
        assert np.array_equal(got[f], brute_safe(d, 0.75, 3, 12, scale)), f


def test_safe_merge_by_contact_only(make, dims):
    vols = {f"s{i}": fragments(i + 50) for i in range(4)}
    got = dense_of(MG.safe_merge(make(vols), dims(vols), 0.5, 2, 14), (5, 12, 14))
    for f, d in vols.items():
        assert np.array_equal(got[f], brute_safe(d, 0.5, 2, 14, (1, 1, 1))), f


@pytest.mark.parametrize("threshold", [2, 4])
def test_large_contact_matches_dense_replay(make, threshold):
    vols = {f"s{i}": fragments(i + 20) for i in range(6)}
    got = dense_of(MG.large_contact_merge(make(vols), threshold), (5, 12, 14))
    for f, d in vols.items():
        assert np.array_equal(got[f], brute_contact(d, threshold)), f


def test_size_mixture_separates_populations(spark):
    rng = np.random.default_rng(0)
    sizes = np.concatenate([rng.lognormal(m, 0.15, n) for m, n in ((2, 200), (5, 120), (8, 80))]).round().astype(int)
    df = spark.createDataFrame([("f", int(s)) for s in sizes] + [("few", 5), ("few", 9)], "fish_id string, volume_vox long")
    cut = MG.gmm_cutoff(*[F.col(f"{p}_{i}") for i in (1, 2) for p in ("mean", "var", "w")])
    got = {r["fish_id"]: r["c"] for r in MG.gmm_params(df).select("fish_id", cut.alias("c")).collect()}
    assert np.exp(5.6) < got["f"] < np.exp(7.4) and got["few"] is None


def test_split_dumbbell_and_errors(make, spark):
    d = np.zeros((9, 9, 25), dtype=int)
    g = np.indices(d.shape)
    for cx in (5, 18):
        d[((g[0] - 4) ** 2 + (g[1] - 4) ** 2 + (g[2] - cx) ** 2) <= 14] = 3
    d[4, 4, 5:19] = 3
    d[0, 0, 0] = 7
    req = spark.createDataFrame(
        [("f", 3, 2, 0.5, 3), ("f", 7, 2, 0.5, 3), ("f", 9, 2, 0.5, 3)], "fish_id string, label int, n_splits int, sigma double, min_distance int"
    )
    out, status = SP.split_labels(make({"f": d}), req)
    got = dense_of(out, d.shape)["f"]
    s = {r["label"]: r["status"] for r in status.collect()}
    assert s[3] == "ok" and s[7].startswith("only") and s[9] == "label not found"
    assert set(np.unique(got)) == {0, 3, 7, 8}
    assert (got == 3).sum() > 30 and (got == 8).sum() > 30 and got[0, 0, 0] == 7
    assert {len(np.unique(got[:, :, :8])), len(np.unique(got[:, :, 16:]))} == {3, 2}


def test_complex_cells_rank(make):
    plus = np.zeros((1, 11, 25), dtype=int)
    plus[0, 5, :11] = plus[0, :, 5] = 2
    plus[0, 5, 14:24] = 1
    got = SH.complex_cells(make({"f": plus}), (1, 1, 1), 1).collect()
    assert [(r["label"], r["n_branches"]) for r in got] == [(2, 4)]


def test_sweep_grids():
    assert SW.sweep_values(0.3, 0.5, 0.1) == [0.3, 0.4, 0.5]
    assert SW.search_values(-6, 6, SW.Stage(0.5, 1.0), 5.8) == [4.8, 5.3, 5.8]
    assert SW.search_values(0, 1, SW.Stage(0.1, 0.5), 3) == [1]


@pytest.mark.parametrize("step", [0.174, 1.0, 3.5])
def test_envelope_is_the_plain_minimum(step):
    rng = np.random.default_rng(int(step * 10))
    lengths = np.array([1, 7, 40, 2, 1, 300, 40])
    starts = np.cumsum(lengths) - lengths
    f = rng.exponential(50, lengths.sum()) * rng.integers(0, 2, lengths.sum())
    want = []
    for a, n in zip(starts, lengths):
        line = np.concatenate(([0.0], f[a: a + n], [0.0]))
        at = np.arange(n + 2)
        want.extend((line[None, :] + (step * (at[:, None] - at[None, :])) ** 2).min(axis=1)[1:-1])
    assert SH._envelope(f, starts, step) == pytest.approx(want, rel=1e-12)
    assert len(SH._envelope(np.zeros(0), np.zeros(0, int), step)) == 0


def test_edt_of_touching_and_hollow_labels(make):
    rng = np.random.default_rng(8)
    dense = rng.integers(0, 3, (5, 40, 30)) * (rng.random((5, 40, 30)) < 0.9)
    dense[:, 10:30, 5:25] = 1
    dense[2, 20, 15] = 0
    scale = (2.0, 0.5, 0.7)
    got = {(r["z"], r["y"], r["x"]): r["dist_um"] for r in SH.edt(make({"a": dense}), scale, strip=16).collect()}
    padded = np.pad(dense, 1)
    sites = np.argwhere(padded > -1)
    for at in np.argwhere(dense)[::17]:
        other = sites[padded[tuple(sites.T)] != dense[tuple(at)]]
        assert got[tuple(map(int, at))] == pytest.approx(np.sqrt((((other - at - 1) * scale) ** 2).sum(axis=1).min()), rel=1e-12)
