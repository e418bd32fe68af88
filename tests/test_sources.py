"""Sources, sinks, history, streams and text on small files."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from voxtable.functions.describe import build_prompts, describe
from voxtable.operators import sweeps as SW
from voxtable.plans import jobs as J
from voxtable.sources import listing as LS, metric_log as ML, sinks as SK, volumes as SV
from voxtable.streaming import metrics as ST

META = """StepSize=1.25 {DisplayName=Pixel Width (µm), Value=6.5} {DisplayName=Pixel Height (µm), Value=6.0}
{DisplayName=TotalConsolidatedOpticalMagnification, Value=1.5}{DisplayName=TotalConsolidatedOpticalMagnification, Value=25}
{DisplayName=TotalConsolidatedOpticalMagnification, Value=40}"""


def test_metadata_files(spark, tmp_path):
    (tmp_path / "a_metadata.txt").write_text(META)
    (tmp_path / "b_metadata.txt").write_text(META.replace("Value=1.5", "Value=15"))
    got = SV.read_metadata(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["path"].endswith("a_metadata.txt")
    assert got[0]["voxel_x_um"] == pytest.approx(6.5 / 37.5) and got[0]["voxel_z_um"] == 1.25
    assert got[0]["anisotropy"] == pytest.approx(1.25 / ((6.5 + 6.0) / 2 / 37.5))


def test_metadata_match_prefers_exact_then_similar(spark):
    img = spark.createDataFrame([("d", "fish_1"), ("d", "Fish_22_scan"), ("d", "zzz"), ("e", "q")], "folder string, stem string")
    met = spark.createDataFrame([("d", "fish_1"), ("d", "fish_2_scan"), ("e", "xxxxxx")], "folder string, meta_stem string")
    got = {(r["folder"], r["stem"]): (r["meta_stem"], r["exact"], r["ratio"]) for r in SV.match_metadata(img, met).collect()}
    want = difflib.SequenceMatcher(None, "fish_22_scan", "fish_2_scan").ratio()
    assert got == {("d", "fish_1"): ("fish_1", True, 1.0), ("d", "Fish_22_scan"): ("fish_2_scan", False, want)}


def test_metadata_match_equals_full_comparison(spark):
    import random

    rnd = random.Random(3)
    names = ["".join(rnd.choice("abcd_1") for _ in range(rnd.randint(2, 9))) for _ in range(60)]
    img, met = names[:30], sorted(set(names[30:]))
    got = SV.match_metadata(
        spark.createDataFrame([("d", n) for n in img], "folder string, stem string"),
        spark.createDataFrame([("d", n) for n in met], "folder string, meta_stem string"),
    )
    want = {}
    for n in img:
        r, m = max((difflib.SequenceMatcher(None, n, m).ratio(), m) for m in met)
        best = min(m for m in met if difflib.SequenceMatcher(None, n, m).ratio() == r)
        if r > 0.3:
            want[n] = (n if n in met else best, 1.0 if n in met else r)
    assert {r["stem"]: (r["meta_stem"], r["ratio"]) for r in got.collect()} == want


def test_listing_from_disk(spark, tmp_path):
    f = tmp_path / "s1"
    f.mkdir()
    for n in ("s1_original.tif", "other_brain_mask.tif", "s1_GROUND_TRUTH.tif", "a_cp_masks.tif", "b_cp_masks.tif"):
        (f / n).write_text("x")
    files = LS.list_files(spark, str(tmp_path))
    found = LS.discover_files(files).first()
    assert found["original"].endswith("s1_original.tif") and found["brain_mask"].endswith("other_brain_mask.tif")
    assert found["cp_masks"] is None and found["no_bg"] is None
    ok = {r["step"]: r["ok"] for r in LS.step_preconditions(LS.discover_files(files)).collect()}
    assert ok == {"monai": True, "bg": True, "sigma": False, "cellprob": False, "branch_radius": True}
    assert LS.gt_samples(files, "_brain_mask.tif").count() == 1


def test_pointers(spark, tmp_path):
    ck = spark.createDataFrame([("m_epoch_0040",), ("m_epoch_0050",)], "name string")
    req = spark.createDataFrame([("m", 40)], "model string, epoch int")
    SV.write_pointer(ck, req, str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    assert SV.resolve_pointers(p, ck).first()["target"] == "m_epoch_0040"
    assert SV.resolve_pointers(p, ck.filter("name <> 'm_epoch_0040'")).count() == 0
    with pytest.raises(FileNotFoundError):
        SV.write_pointer(ck, spark.createDataFrame([("m", 41)], "model string, epoch int"), str(tmp_path / "q"))
    best = spark.createDataFrame([("m", "f", 50.0, 0.7), ("m", "g", 40.0, 0.9)], "model string, fish_id string, p1 double, iou double")
    ok = spark.createDataFrame([("f", True), ("g", False)], "fish_id string, verified boolean")
    assert J.repoint(p, best, ok).first()["target"] == "m_epoch_0050"


def test_cache_rebuilds_on_other_fingerprint(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    root = str(tmp_path / "c")
    for f in ({"a": 1.0, "s": "x"}, {"a": 1.0 + 1e-7, "s": "x"}, {"a": 1.1, "s": "x"}, {"a": 1.1, "s": "y"}):
        assert SV.cached_stage(spark, root, f, build).count() == 3
    assert len(calls) == 3


def test_stats_csv_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("f", 1, 2.5, 1, 2)], "fish_id string, label int, elongation double, nearest_neighbor_label int, nearest_neighbor_dist_um int")
    SK.write_stats(df, str(tmp_path / "s"), ["elongation", "nn_1st", "gone"])
    back = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert back.columns == ["fish_id", "label", "elongation", "nearest_neighbor_label", "nearest_neighbor_dist_um"]
    split = spark.createDataFrame([("a", "train"), ("b", "val")], "fish_id string, split string")
    SK.write_manifest(split, str(tmp_path / "m"))
    rows = [json.loads(line) for p in (tmp_path / "m" / "split=val").glob("*.json") for line in p.read_text().splitlines()]
    assert rows == [{"fish_id": "b", "seed": 16}]


def test_split_is_disjoint_and_checked(spark):
    df = spark.createDataFrame([(f"s{i}", i < 15) for i in range(20)], "fish_id string, positive boolean")
    a = {r["fish_id"]: r["split"] for r in SW.split_samples(df, 3, 2).collect()}
    assert len(a) == 20 and sorted(a.values()).count("val") == 3 and sorted(a.values()).count("test") == 2
    assert all(a[f"s{i}"] == "train" for i in range(15, 20))
    assert a == {r["fish_id"]: r["split"] for r in SW.split_samples(df.repartition(5), 3, 2).collect()}
    with pytest.raises(ValueError):
        SW.split_samples(df, 10, 5)


def test_two_line_logs_batch_and_stream(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    scores = [0.5, 0.7, 0.6, 0.7, 0.65]
    lines = []
    for i, s in enumerate(scores, 1):
        lines += [f"Epoch {i * 10} Summary:", "  loss 1", f"  Full-brain Dice: {s} [MODEL SELECTION]"]
    text = "\n".join(lines)
    (logs / "run.txt").write_text(text)
    m = ML.read_metric_log(spark, str(logs), "two_line")
    assert [(r["epoch"], r["value"]) for r in m.orderBy("seq").collect()] == [(10 * (i + 1), s) for i, s in enumerate(scores)]
    batch = SW.patience(m, 3, True).first()
    assert (batch["best_epoch"], batch["checkpoints_since_best"], batch["exceeded"]) == (20, 3, True)
    assert SW.patience(m, 0, True).first()["exceeded"] is False
    # Stream the same log in two files cut in the middle of a record.
    src = tmp_path / "tail"
    src.mkdir()
    numbered = [f"{i}\t{line}" for i, line in enumerate(lines)]
    import os

    for k, part in enumerate((numbered[:4], numbered[4:])):
        (src / f"run.{k}.log").write_text("\n".join(part))
        os.utime(src / f"run.{k}.log", (1_700_000_000 + k, 1_700_000_000 + k))
    tail = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src)).select(
        F.lit("run").alias("run_id"), F.split("value", "\t", 2)[0].cast("long").alias("seq"), F.split("value", "\t", 2)[1].alias("line")
    )
    out = ST.run_to_table(ST.monitor(ST.stream_metrics(tail, "two_line"), 3, True), str(tmp_path / "o"), str(tmp_path / "cp"), "update")
    last = ST.latest_per_run(out).first()
    assert (last["n_checkpoints"], last["best_value"], last["best_epoch"], last["checkpoints_since_best"], last["exceeded"]) == (5, 0.7, 20, 3, True)
    ids = [r["run_id"] for r in ST.stream_lines(spark, str(src)).writeStream.format("memory").queryName("t_lines").trigger(availableNow=True).start().processAllAvailable() or spark.table("t_lines").collect()]
    assert set(ids) == {"run"} and len(ids) == len(lines)


def best_in_order(rows, patience, sign):
    """All (seq, epoch, value) so far, in log order; a repeated seq is one line with its greatest values."""
    lines = {}
    for seq, epoch, value in rows:
        e, v = lines.get(seq, (None, None))
        lines[seq] = (max((x for x in (e, epoch) if x is not None), default=None), max((x for x in (v, value) if x is not None), default=None))
    n, best, since, head = 0, None, 0, None
    for seq in sorted(lines):
        epoch, value = lines[seq]
        head = epoch if epoch is not None else head
        if value is None or head is None:
            continue
        n += 1
        if best is None or sign * value > sign * best[0]:
            best, since = (value, head), 0
        else:
            since += 1
    return (n, *best, since, 0 < patience <= since) if n else None


@pytest.mark.parametrize("case", ["late best", "late head", "random"])
def test_monitor_is_exact_for_late_rows(spark, tmp_path, case):
    """After every batch the monitor says what a pass over all lines so far in log order says."""
    import os
    import random

    if case == "late best":
        batches = [[(1, 1, 5.0), (3, 3, 4.0), (4, 4, 3.0)], [(2, 2, 2.0)]]
    elif case == "late head":
        batches = [[(2, None, 5.0), (4, None, 4.0)], [(3, 30, None)], [(1, 10, None)], [(4, None, 4.0), (5, None, 9.0)]]
    else:
        draw = random.Random(4)
        rows = [(i, draw.choice([i, None]), draw.choice([float(draw.randint(1, 30)), None])) for i in range(1, 61)]
        draw.shuffle(rows)
        batches = [rows[k: k + 10] for k in range(0, 60, 10)]
    src = tmp_path / "in"
    schema = "run_id string, seq long, epoch int, value double"
    for k, batch in enumerate(batches):
        spark.createDataFrame([("r", *x) for x in batch], schema).coalesce(1).write.parquet(str(src / f"b{k}"))
        for f in (src / f"b{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    out = ST.run_to_table(ST.monitor(stream, 2, False, block=4), str(tmp_path / "o"), str(tmp_path / "cp"), "update")
    got = {r["batch_id"]: tuple(r)[1:6] for r in out.select("run_id", "n_checkpoints", "best_value", "best_epoch", "checkpoints_since_best", "exceeded", "batch_id").collect()}
    for k in range(len(batches)):
        want = best_in_order([x for b in batches[: k + 1] for x in b], 2, -1.0)
        assert got.get(k) == want, (k, got.get(k), want)
    if case == "late best":
        assert got[1] == (4, 2.0, 2, 2, True)


def test_description_and_prompt(spark):
    row = spark.createDataFrame(
        [(4, 12345.678, 2.6, "X", 0.5, 0.8, 3, 2, 4.25, "Ramified", 1.0, 2.0, 3.0)],
        "label int, volume_um3 double, elongation double, principal_axis_dir string, sphericity double, solidity double, n_branches int, n_endpoints int,"
        "mean_branch_len_um double, morphotype string, centroid_z_um double, centroid_y_um double, centroid_x_um double",
    )
    text = row.select(describe().alias("d")).first()["d"]
    assert text == (
        "Label 4: Elongated along x-axis (2.6:1), volume 12,346 µm³, centroid Z=1.0 Y=2.0 X=3.0 µm. "
        "Slightly lobulated surface, sphericity 0.50, solidity 0.80. 3 branches, 2 endpoints (mean 4.3 µm). Morphotype: Ramified."
    )
    assert "Elongation (longest/shortest axis): 2.60" in build_prompts(row).first()["prompt"]


def test_calibration_modes(spark):
    rows = [("sigma_xy", "a", 1.0, True, "2024-01-01"), ("sigma_xy", "a", 3.0, True, "2024-01-02"), ("sigma_xy", "b", 2.0, True, "2024-01-01"),
            ("sigma_xy", "c", 9.0, False, "2024-01-01"), ("erosion_voxels", "a", 1.0, True, "2024-01-01"), ("erosion_voxels", "b", 2.0, True, "2024-01-01")]
    h = spark.createDataFrame(rows, "config_key string, fish_id string, value double, verified boolean, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r["config_key"]: (r["value"], r["n_samples"]) for r in SW.recommend_all(h).collect()}
    assert got == {"sigma_xy": (2.5, 2), "erosion_voxels": (2.0, 2)}
    assert SW.recommend(h, "max").filter("config_key = 'sigma_xy'").first()["value"] == 3.0


def test_pick_epochs(spark):
    have = spark.createDataFrame([(e,) for e in (10, 20, 30, 50)], "epoch int")
    assert sorted(r["epoch"] for r in SW.pick_epochs(have, 30, 10).collect()) == [10, 20, 30, 50]
    with pytest.raises(ValueError):
        SW.pick_epochs(have, 40, 10)
