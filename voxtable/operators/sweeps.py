"""Parameter grids, sweep averages, winners, coarse-to-fine search and calibration history."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..schemas import KEYS
from ..session import materialize

# fixed values: how each calibration key is combined over samples
MODES = {
    "min_volume_vox": "min",
    "min_hole_size_vox": "min",
    "max_volume_vox": "max",
    "cellpose_branch_radius": "max",
    "monai_threshold": "mean",
    "erosion_voxels": "mean",
    "bg_tolerance": "mean",
    "signal_erosion_voxels": "mean",
    "sigma_xy": "mean",
    "sigma_z": "mean",
    "cellpose_cellprob": "mean",
}
ROUNDED = ("erosion_voxels", "signal_erosion_voxels")


def sweep_values(lo: float, hi: float, step: float) -> list[float]:
    """lo, lo + step, .. up to hi (kept within half a step), rounded to 4 decimals."""
    n = math.ceil((hi + step / 2 - lo) / step)
    return [round(lo + i * step, 4) for i in range(max(n, 0))]


@dataclass(frozen=True)
class Stage:
    """One pass of a search: its step, and how far it reaches around the last winner (None: the whole range)."""

    step: float
    reach: float | None = None


def search_values(lo: float, hi: float, stage: Stage, winner: float | None = None) -> list[float]:
    """Values of one stage.  Both ends are held inside [lo, hi], so a winner outside leaves the nearer end."""
    if stage.reach is None or winner is None:
        return sweep_values(lo, hi, stage.step)
    first, last = (min(max(winner + side * stage.reach, lo), hi) for side in (-1, 1))
    return sweep_values(first, last, stage.step)


def grid(spark, p1: Sequence[float], p2: Sequence[float] = (0.0,)) -> DataFrame:
    return spark.createDataFrame([(float(a), float(b)) for a in p1 for b in p2], "p1 double, p2 double")


def cross_grid(rows: DataFrame, points: Sequence[tuple[float, float]]) -> DataFrame:
    """Every row under every grid point. The grid is a literal list, exploded in place: no join, no shuffle."""
    at = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("p1"), F.lit(float(b)).alias("p2")) for a, b in points]))
    return rows.withColumn("_g", at).withColumn("p1", F.col("_g.p1")).withColumn("p2", F.col("_g.p2")).drop("_g")


def sweep_avg(results: DataFrame, n_cells: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean IoU and Dice per grid point; with ``n_cells`` only points where every cell was scored."""
    avg = results.groupBy(*keys, "p1", "p2").agg(
        F.avg("iou").alias("iou"), F.avg("dice").alias("dice"), F.count("*").alias("n_scored")
    )
    return avg if n_cells is None else avg.filter(F.col("n_scored") == n_cells)


def best_point(results: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS, needs_tp: bool = False) -> DataFrame:
    """The grid point with the highest ``order`` columns; ties take the first grid value.

    ``needs_tp`` drops points with tp = 0 unless a sample has no other.
    """
    keys = list(keys)
    rank = [F.col(c) for c in order] + [-F.col("p1"), -F.col("p2")]
    if needs_tp:
        rank = [(F.col("tp") > 0).cast("int"), *rank]
    cols = [c for c in results.columns if c not in keys]
    top = results.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("_t"))
    return top.select(*keys, "_t.*")


def winner_per_cell(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Grid point with the highest IoU per cell; first grid value on ties."""
    top = F.max_by(F.struct("p1", "p2", "iou"), F.struct("iou", -F.col("p1"), -F.col("p2")))
    return results.groupBy(*keys, "label").agg(top.alias("_t")).select(*keys, "label", "_t.*")


def sieve(score: Callable[[list[float]], DataFrame], lo: float, hi: float, stages: Sequence[Stage]) -> DataFrame:
    """(stage, value, score, is_best) of a coarse-to-fine search; the answer is the last stage's best row.

    ``score(values)`` is one Spark job that gives (value, score) for its values, empty only when there is nothing to
    score.  Of equal scores the least value wins.  Only a stage's winner reaches the driver.
    """
    tables: list[DataFrame] = []
    winner = None
    for number, stage in enumerate(stages, 1):
        rows = materialize(score(search_values(lo, hi, stage, winner)).select(F.lit(number).alias("stage"), "value", "score"), "sieve")
        winner = rows.agg(F.max_by("value", F.struct("score", -F.col("value")))).first()[0]
        tables.append(rows.withColumn("is_best", F.coalesce(F.col("value") == F.lit(winner), F.lit(False))))
    return reduce(DataFrame.unionByName, tables)


def recommend(history: DataFrame, mode: str = "mean") -> DataFrame:
    """Latest verified value per (key, sample), combined per key by min, max or mean."""
    fn = {"min": F.min, "max": F.max, "mean": F.avg}[mode]
    latest = latest_values(history)
    return latest.groupBy("config_key").agg(fn("value").alias("value"), F.count("*").alias("n_samples"))


def latest_values(history: DataFrame) -> DataFrame:
    seen = history.filter("verified").groupBy("config_key", "fish_id")
    return seen.agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def recommend_all(history: DataFrame) -> DataFrame:
    """Each known key by its own mode; rounded keys become whole numbers."""
    mode = F.create_map(*[F.lit(v) for kv in MODES.items() for v in kv])
    agg = latest_values(history).groupBy("config_key").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mid"), F.count("*").alias("n_samples")
    )
    agg = agg.withColumn("mode", mode[F.col("config_key")]).filter("mode is not null")
    value = F.when(F.col("mode") == "min", F.col("lo")).when(F.col("mode") == "max", F.col("hi")).otherwise(F.col("mid"))
    value = F.when(F.col("config_key").isin(*ROUNDED), F.bround(value)).otherwise(value)
    return agg.select("config_key", "mode", value.alias("value"), "n_samples")


def grid_report(results: DataFrame, metric: str, p1_values: Sequence[float], keys: Sequence[str] = KEYS, decimals: int = 1) -> DataFrame:
    """One row per p2, one column per p1 (p1 values are given, so the pivot needs no extra job)."""
    cols = [
        F.max(F.when(F.col("p1") == v, F.bround(metric, decimals))).alias(f"p1_{v:g}".replace("-", "m").replace(".", "_"))
        for v in p1_values
    ]
    return results.groupBy(*keys, "p2").agg(*cols)


def grid_lines(results: DataFrame, metric: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Text form of a sweep table: one line per point, the best marked."""
    best = best_point(results.select(*keys, "p1", "p2", metric), [metric], keys).select(*keys, "p1", "p2", F.lit(True).alias("_best"))
    r = results.join(best, [*keys, "p1", "p2"], "left")
    mark = F.when(F.col("_best"), F.lit("  <- best")).otherwise(F.lit(""))
    return r.select(*keys, "p1", "p2", F.concat(F.format_string("%8.2f %8.2f %7.1f", "p1", "p2", metric), mark).alias("line"))


def pick_epochs(available: DataFrame, recommended: int, save_every: int, below: int = 2, above: int = 2, check: bool = True) -> DataFrame:
    """Epochs around the recommended one, in save steps, that exist in ``available`` (column epoch)."""
    if check and not available.filter(F.col("epoch") == recommended).take(1):
        raise ValueError(f"epoch {recommended} has no checkpoint")
    wanted = [recommended + k * save_every for k in range(-below, above + 1)]
    return available.filter(F.col("epoch").isin(wanted)).select("epoch").distinct()


def patience(metrics: DataFrame, limit: int, higher_is_better: bool, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Best value and epoch so far, checkpoints since the first best, and whether the limit is reached.

    ``metrics``: seq (log order), epoch, value. Two aggregations, so a long run
    is never sorted in one task.
    """
    keys = list(keys)
    score = F.col("value") if higher_is_better else -F.col("value")
    best = metrics.groupBy(*keys).agg(
        F.max_by(F.struct("seq", "epoch", "value"), F.struct(score.alias("s"), -F.col("seq"))).alias("_b")
    )
    after = metrics.join(best, keys).groupBy(*keys).agg(
        F.count("*").alias("n_checkpoints"),
        F.first("_b.value").alias("best_value"),
        F.first("_b.epoch").alias("best_epoch"),
        F.sum((F.col("seq") > F.col("_b.seq")).cast("int")).alias("checkpoints_since_best"),
    )
    hit = F.lit(False) if limit <= 0 else F.col("checkpoints_since_best") >= limit
    return after.withColumn("exceeded", hit)


def running_best(metrics: DataFrame, higher_is_better: bool, keys: Sequence[str] = ("run_id",), block: int = 4096) -> DataFrame:
    """Best value up to each checkpoint. Long runs are scanned in blocks of ``seq`` so no window holds a whole run."""
    keys = list(keys)
    fn = F.max if higher_is_better else F.min
    pick = F.greatest if higher_is_better else F.least
    m = metrics.withColumn("_k", F.floor(F.col("seq") / block))
    heads = m.groupBy(*keys, "_k").agg(fn("value").alias("_h"))
    before = W.partitionBy(*keys).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(*keys, "_k", fn("_h").over(before).alias("_prev"))
    inside = W.partitionBy(*keys, "_k").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    m = m.withColumn("_in", fn("value").over(inside)).join(heads, [*keys, "_k"])
    return m.withColumn("best_so_far", pick("_in", F.coalesce("_prev", "_in"))).drop("_k", "_in", "_prev")


def split_samples(samples: DataFrame, n_val: int = 5, n_test: int = 5, seed: int = 16, id_col: str = "fish_id") -> DataFrame:
    """train / val / test by a seeded hash order; rows with positive = false always train.

    Val and test are the first ids in hash order, found as a global top-k.
    """
    from ..numbering import number_rows

    pos = samples.filter("positive")
    n_pos = pos.count()
    if n_pos - n_val - n_test < 1:
        raise ValueError(f"{n_pos} samples are not enough for {n_val} val + {n_test} test + 1 train")
    draw = [F.xxhash64(id_col, F.lit(seed)), F.col(id_col)]
    held = number_rows(pos.select(id_col).orderBy(*draw).limit(n_val + n_test).withColumn("_one", F.lit(1)), ["_one"], draw, "_r")
    held = held.select(id_col, F.when(F.col("_r") <= n_val, F.lit("val")).otherwise(F.lit("test")).alias("_s"))
    return samples.join(held, id_col, "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_s")
