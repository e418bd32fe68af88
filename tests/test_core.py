"""Numbering, quantiles, graph groups, components and stencils on small volumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import dense_of
from voxtable.graph import connected
from voxtable.numbering import number_rows, quantiles, running_total
from voxtable.operators import components as CC, labels as L, masks as M, stencils as S


def test_number_rows_and_running_total(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 3 else f"k{i % 7}", int(v), i) for i, v in enumerate(rng.integers(0, 50, 3000))]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = number_rows(df, ["k"], [F.desc("v"), F.col("i")]).collect()
    want = {}
    for k, v, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        want[i] = want.get(("n", k), 0) + 1
        want[("n", k)] = want[i]
    assert all(r["rn"] == want[r["i"]] for r in got)
    tot = running_total(df, ["k"], [F.col("i")], "v").collect()
    acc = {}
    for k, v, i in sorted(rows, key=lambda r: r[2]):
        acc[k] = acc.get(k, 0) + v
        acc[i] = acc[k]
    assert all(r["running"] == acc[r["i"]] for r in tot)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = {"a": rng.normal(size=997), "b": rng.integers(0, 5, 40).astype(float), "c": np.array([3.5])}
    df = spark.createDataFrame([(k, float(v)) for k, a in vals.items() for v in a], "k string, v double")
    for r in quantiles(df, ["k"], "v", {"q1": 0.01, "q25": 0.25, "q99": 0.99, "top": 1.0}).collect():
        for name, p in (("q1", 1), ("q25", 25), ("q99", 99), ("top", 100)):
            assert r[name] == pytest.approx(np.percentile(vals[r["k"]], p))


def test_whole_volume_quantiles_count_zeros(spark, make, dims):
    dense = np.zeros((3, 4, 5), dtype=int)
    dense[1, 1, :3] = [10, 20, 30]
    v = make({"f": dense}, "value").withColumn("value", F.col("value").cast("double"))
    q = M.whole_quantiles(v, dims({"f": dense}), {"p95": 0.95, "p99": 0.99}).first()
    assert q["p95"] == pytest.approx(np.percentile(dense, 95))
    assert q["p99"] == pytest.approx(np.percentile(dense, 99))
    r = M.value_range(v, dims({"f": dense})).first()
    assert (r["v_min"], r["v_max"]) == (0.0, 30.0)
    full = np.full((1, 1, 2), 7)
    r = M.value_range(make({"f": full}, "value"), dims({"f": full})).first()
    assert (r["v_min"], r["v_max"]) == (7.0, 7.0)


def test_connected_long_chain_and_hub(spark):
    chain = [("f", i, i + 1) for i in range(400)]
    hub = [("g", 1000, i) for i in range(300)]
    df = spark.createDataFrame(chain + hub, "fish_id string, a long, b long")
    got = connected(df, ["fish_id"]).groupBy("fish_id").agg(F.countDistinct("root").alias("n"), F.min("root").alias("r"), F.count("*").alias("c"))
    assert {r["fish_id"]: (r["n"], r["r"], r["c"]) for r in got.collect()} == {"f": (1, 0, 401), "g": (1, 0, 301)}


def snake():
    d = np.zeros((1, 21, 20), dtype=int)
    d[0, ::2, :] = 1
    for i, y in enumerate(range(1, 21, 2)):
        d[0, y, -1 if i % 2 == 0 else 0] = 1
    return d


def test_components_micro_volumes(make):
    diag = np.zeros((2, 2, 2), dtype=int)
    diag[0, 0, 0] = diag[1, 1, 1] = 1
    vox = make({"diag": diag, "snake": snake()})
    for conn, n in ((26, 1), (6, 2)):
        c = CC.components(vox, conn=conn).groupBy("fish_id").agg(F.countDistinct("component").alias("n")).collect()
        assert {r["fish_id"]: r["n"] for r in c} == {"diag": n, "snake": 1}


@pytest.mark.parametrize("conn", [4, 6, 8, 26])
def test_components_do_not_depend_on_bricks(make, conn):
    rng = np.random.default_rng(conn)
    vox = make({"a": (rng.random((9, 11, 10)) < 0.3).astype(int), "b": snake()})
    whole = {tuple(r[:4]): r["component"] for r in CC.components(vox, conn=conn).select("fish_id", "z", "y", "x", "component").collect()}
    cut = CC.components(vox, conn=conn, brick=(2, 3, 4)).select("fish_id", "z", "y", "x", "component").collect()
    assert {tuple(r[:4]): r["component"] for r in cut} == whole


def test_hole_fill_limits(make):
    ring = np.zeros((1, 5, 5), dtype=int)
    ring[0, 1:4, 1:4] = 1
    ring[0, 2, 2] = 0
    mask = make({"ring": ring}).select("fish_id", "z", "y", "x")
    assert [S.fill_holes2d(mask, m).count() for m in (0, 1, 2)] == [9, 8, 9]
    box = np.ones((3, 3, 3), dtype=int)
    box[1, 1, 1] = 0
    m = make({"b": box}).select("fish_id", "z", "y", "x")
    assert S.fill_holes3d(m).count() == 27
    box[0, 1, 1] = 0  # now open to the volume edge
    assert S.fill_holes3d(make({"b": box}).select("fish_id", "z", "y", "x")).count() == 25


def test_contact_of_plates_and_erosion_is_subset(make, dims):
    d = np.zeros((2, 5, 5), dtype=int)
    d[0], d[1] = 1, 2
    got = {(r["source"], r["target"]): r["contact"] for r in S.contact(make({"p": d})).collect()}
    assert got == {(1, 2): 25, (2, 1): 25}
    rng = np.random.default_rng(3)
    m = (rng.random((6, 12, 12)) < 0.8).astype(int)
    mask = make({"m": m}).select("fish_id", "z", "y", "x")
    e = S.erode3d(mask, dims({"m": m}), 1)
    assert e.join(mask, ["fish_id", "z", "y", "x"], "left_anti").count() == 0


def test_relabel_is_a_bijection_and_volume_is_kept(make):
    rng = np.random.default_rng(5)
    d = rng.integers(0, 30, (4, 6, 6)) * 3
    lab = make({"f": d})
    new = L.relabel_by_volume(lab)
    sizes = [r["count"] for r in new.groupBy("label").count().orderBy("label").collect()]
    assert sizes == sorted(sizes, reverse=True) and new.count() == lab.count()
    assert [r["label"] for r in new.select("label").distinct().orderBy("label").collect()] == list(range(1, len(sizes) + 1))


def test_join_labels_checks(make, spark):
    d = np.array([[[1, 2, 0, 3]]])
    lab = make({"f": d})
    req = spark.createDataFrame([("f", 1, 2)], "fish_id string, label_a int, label_b int")
    assert dense_of(L.join_labels(lab, req), d.shape)["f"].tolist() == [[[1, 1, 0, 3]]]
    for a, b in ((1, 1), (1, 9)):
        with pytest.raises(ValueError):
            L.join_labels(lab, spark.createDataFrame([("f", a, b)], "fish_id string, label_a int, label_b int"))


def test_random_fill_is_repeatable(make, dims):
    d = np.zeros((2, 6, 6), dtype=int)
    d[:, 2:4, 2:4] = 50
    v = make({"f": d}, "value").withColumn("value", F.col("value").cast("double"))
    m = make({"f": d > 0}).select("fish_id", "z", "y", "x")
    one = sorted(map(tuple, M.fill_outside_random(v, m, dims({"f": d}), 3).collect()))
    assert one == sorted(map(tuple, M.fill_outside_random(v, m, dims({"f": d}), 3).collect()))
    assert len(one) == d.size


def test_stage_tables_can_be_cleared(spark):
    from voxtable.session import clear_scratch, materialize

    assert materialize(spark.range(5)).count() == 5
    assert clear_scratch(spark) is True
    assert materialize(spark.range(3)).count() == 3
