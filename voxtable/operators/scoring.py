"""Object matching against ground truth and merge-threshold choice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..graph import connected
from ..joins import spread_by
from ..schemas import KEYS, field_types
from ..session import materialize
from .labels import volumes_of
from .pairs import overlap

BUCKETS = 1024  # groups that a sample's blocks of the overlap graph are dealt into


def iou_edges(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """gt, pred, inter, gt_vox, pred_vox, iou for every overlapping pair."""
    keys = list(keys)
    pv = volumes_of(pred, keys).withColumnsRenamed({"label": "pred", "volume_vox": "pred_vox"})
    gv = volumes_of(gt, keys).withColumnsRenamed({"label": "gt", "volume_vox": "gt_vox"})
    e = overlap(pred, gt, keys).join(pv, [*keys, "pred"]).join(gv, [*keys, "gt"])
    return e.withColumn("iou", F.col("inter") / (F.col("gt_vox") + F.col("pred_vox") - F.col("inter")))


def best_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Row/column pairs of the one-to-one assignment with the largest total score.

    Shortest augmenting paths with potentials; rows must not outnumber columns
    (the caller transposes).
    """
    if score.shape[0] > score.shape[1]:
        return [(r, c) for c, r in best_assignment(score.T)]
    cost = -score
    n, m = cost.shape
    row_pot, col_pot = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist = np.full(m, np.inf)
        came = np.full(m, -1)
        closed = np.zeros(m, dtype=bool)
        row, col, reached = start, -1, 0.0
        rows, offs = [start], [0.0]
        while True:
            trial = reached + cost[row] - row_pot[row] - col_pot
            better = ~closed & (trial < dist)
            dist[better] = trial[better]
            came[better] = col
            col = int(np.argmin(np.where(closed, np.inf, dist)))
            reached = dist[col]
            closed[col] = True
            if owner[col] < 0:
                break
            row = int(owner[col])
            rows.append(row)
            offs.append(reached)
        for r, o in zip(rows, offs):
            row_pot[r] += reached - o
        col_pot[closed] -= reached - dist[closed]
        while col >= 0:
            prev = int(came[col])
            owner[col] = owner[prev] if prev >= 0 else start
            col = prev
    return [(int(r), c) for c, r in enumerate(owner) if r >= 0]


def assign(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One-to-one pairs maximising the summed IoU per sample.

    An object whose partners overlap nothing else keeps the best of them, the lowest label of equal ones. The rest
    falls into independent blocks of the overlap graph, each solved by itself; a sample's blocks go to the tasks in BUCKETS.
    """
    keys = list(keys)
    edges = materialize(edges, "overlaps")
    for side, n in (("gt", "_dg"), ("pred", "_dp")):
        edges = edges.join(edges.groupBy(*keys, side).agg(F.count("*").alias(n)), [*keys, side])
    for side, n in (("gt", "_dp"), ("pred", "_dg")):
        edges = edges.join(edges.groupBy(*keys, side).agg(F.max(n).alias(f"_m{n}")), [*keys, side])
    edges = materialize(edges, "iou")
    cols = [c for c in edges.columns if c not in ("_dg", "_dp", "_m_dg", "_m_dp")]

    def star(rows: DataFrame, side: str, other: str) -> DataFrame:
        top = F.max_by(F.struct(*cols), F.struct("iou", -F.col(other)))
        return rows.groupBy(*keys, side).agg(top.alias("_t")).select("_t.*")

    lone = star(edges.filter("_m_dp = 1"), "gt", "pred").unionByName(star(edges.filter("_m_dp > 1 and _m_dg = 1"), "pred", "gt"))
    crowd = edges.filter("_m_dp > 1 and _m_dg > 1").select(*cols)
    node_g = (F.col("gt").cast("long") * 2).alias("a")
    node_p = (F.col("pred").cast("long") * 2 + 1).alias("b")
    blocks = connected(crowd.select(*keys, node_g, node_p), keys).withColumnsRenamed({"node": "_a", "root": "_block"})
    crowd = crowd.withColumn("_a", node_g).join(blocks, [*keys, "_a"]).drop("_a")
    schema = T.StructType([*field_types(lone, lone.columns)])

    def solve(gt: np.ndarray, pred: np.ndarray, iou: np.ndarray) -> list[bool]:
        g, gi = np.unique(gt, return_inverse=True)
        p, pi = np.unique(pred, return_inverse=True)
        score = np.zeros((len(g), len(p)))
        score[gi, pi] = iou
        chosen = set(best_assignment(score))
        return [pair in chosen for pair in zip(gi.tolist(), pi.tolist())]

    def solve_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block", kind="stable")
        cols = [pdf[c].to_numpy() for c in ("gt", "pred", "iou")]
        ends = np.flatnonzero(np.diff(pdf["_block"].to_numpy())) + 1
        keep = [k for block in zip(*[np.split(c, ends) for c in cols]) for k in solve(*block)]
        return pdf.loc[keep, schema.names]

    crowd = crowd.withColumn("_bucket", F.pmod(F.xxhash64("_block"), F.lit(BUCKETS)).cast("int"))
    return lone.unionByName(spread_by(crowd, [*keys, "_bucket"]).groupBy(*keys, "_bucket").applyInPandas(solve_bucket, schema))


def match_objects(pred: DataFrame, gt: DataFrame, threshold: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accepted matches: gt, pred, iou, dice (x100), sizes and size_delta."""
    hits = assign(iou_edges(pred, gt, keys), keys).filter(F.col("iou") >= threshold)
    i = F.col("iou")
    return hits.select(
        *keys,
        "gt",
        "pred",
        (i * 100).alias("iou"),
        (2 * i / (1 + i) * 100).alias("dice"),
        "pred_vox",
        "gt_vox",
        ((F.col("pred_vox") - F.col("gt_vox")) / F.col("gt_vox") * 100).alias("size_delta"),
    )


def unmatched(matches: DataFrame, pred: DataFrame, gt: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """False positives and negatives: kind (fp / fn) and label."""
    fp = pred.select(*keys, "label").distinct().join(
        matches.select(*keys, F.col("pred").alias("label")), [*keys, "label"], "left_anti"
    )
    fn = gt.select(*keys, "label").distinct().join(
        matches.select(*keys, F.col("gt").alias("label")), [*keys, "label"], "left_anti"
    )
    return fp.withColumn("kind", F.lit("fp")).unionByName(fn.withColumn("kind", F.lit("fn")))


def score_counts(tp, fp, fn):
    """Score of a match count: TP - 0.5 (FP + FN)."""
    return tp - (fp + fn) * 0.5


def score_against_gt(pred: DataFrame, gt: DataFrame, threshold: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per sample: n_pred, n_gt, tp, fp, fn, score and mean IoU / Dice over the matches."""
    keys = list(keys)
    m = match_objects(pred, gt, threshold, keys)
    agg = m.groupBy(*keys).agg(
        F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"), F.avg("dice").alias("mean_dice")
    )
    n_pred = pred.groupBy(*keys).agg(F.countDistinct("label").alias("n_pred"))
    n_gt = gt.groupBy(*keys).agg(F.countDistinct("label").alias("n_gt"))
    out = n_pred.join(n_gt, keys, "full").join(agg, keys, "left").na.fill(0)
    out = out.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))
    return out.select(
        *keys, "n_pred", "n_gt", "tp", "fp", "fn", score_counts(F.col("tp"), F.col("fp"), F.col("fn")).alias("score"),
        "mean_iou", "mean_dice",
    )


def score_lines(matches: DataFrame) -> DataFrame:
    """Report line per match: ids, IoU %, Dice %, sizes and size difference %."""
    line = F.format_string(
        "%6d %6d %7.1f %7.1f %9d %9d %+8.1f", "pred", "gt", "iou", "dice", "pred_vox", "gt_vox", "size_delta"
    )
    return matches.withColumn("line", line)


def summary_line(scores: DataFrame) -> DataFrame:
    return scores.withColumn("line", F.format_string("TP=%d  FP=%d  FN=%d  Score=%+.1f", "tp", "fp", "fn", "score"))


def best_match(pred: DataFrame, cells: DataFrame, keys: Sequence[str] = KEYS, by: Sequence[str] = ()) -> DataFrame:
    """Best-IoU predicted object for each true cell (``cells``: z, y, x, label = cell).

    A cell nothing overlaps gets iou 0 and size_delta -100. Ties take the lower
    predicted id. ``by`` adds sweep columns held by ``pred``.
    """
    keys, by = list(keys), list(by)
    scope = [*keys, *by]
    pv = pred.groupBy(*scope, "label").agg(F.count("*").alias("pred_vox")).withColumnRenamed("label", "pred")
    gv = volumes_of(cells, keys).withColumnsRenamed({"label": "gt", "volume_vox": "gt_vox"})
    e = overlap(pred, cells, keys, by).join(pv, [*scope, "pred"]).join(gv.select(*keys, "gt", "gt_vox"), [*keys, "gt"])
    e = e.withColumn("iou", F.col("inter") / (F.col("gt_vox") + F.col("pred_vox") - F.col("inter")))
    top = e.groupBy(*scope, "gt").agg(F.max_by(F.struct("pred", "pred_vox", "iou"), F.struct("iou", -F.col("pred"))).alias("_t"))
    base = pred.select(*scope).distinct().join(gv, keys) if by else gv
    out = base.join(top, [*scope, "gt"], "left")
    i = F.coalesce(F.col("_t.iou"), F.lit(0.0))
    vox = F.coalesce(F.col("_t.pred_vox"), F.lit(0))
    return out.select(
        *scope,
        "gt",
        (i * 100).alias("iou"),
        (2 * i / (1 + i) * 100).alias("dice"),
        vox.alias("pred_vox"),
        F.when(vox > 0, (vox - F.col("gt_vox")) / F.col("gt_vox") * 100).otherwise(F.lit(-100.0)).alias("size_delta"),
    )


def recommend_merge(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The (gap, contact) pair with the fewest missed plus false merges.

    A sample is left apart when gap > max_gap and contact < min_contact. All
    observed values, plus a gap below and a contact above every sample, are
    candidates; ties take the smaller gap, then the smaller contact.

    Samples are first reduced to counts per (gap, contact), so the raw samples are
    read once and never meet the candidate grid.
    """
    keys = list(keys)
    s = samples.withColumn("_sm", (F.col("kind") == "should_merge").cast("long"))
    cells = s.groupBy(*keys, "gap_um", "contact_vox").agg(
        F.sum("_sm").alias("sm"), (F.count("*") - F.sum("_sm")).alias("snm")
    )
    cells = materialize(cells, "samples")
    ends = cells.groupBy(*keys).agg(
        (F.min("gap_um") - 1.0).alias("g_lo"),
        (F.max("contact_vox") + 1).alias("c_hi"),
        F.sum("sm").alias("n_sm"),
        F.sum("snm").alias("n_snm"),
    )
    gap_c = cells.select(*keys, F.col("gap_um").alias("g")).unionByName(ends.select(*keys, F.col("g_lo").alias("g"))).distinct()
    con_c = cells.select(*keys, F.col("contact_vox").alias("c")).unionByName(
        ends.select(*keys, F.col("c_hi").alias("c"))
    ).distinct()
    # Two running sums over the candidate grid: contacts below c, then gaps above g.
    # Gaps are lattice distances and contacts are face counts, so both lists are short.
    at = cells.select(*keys, F.col("gap_um").alias("g"), F.col("contact_vox").alias("c"), "sm", "snm")
    grid = con_c.join(gap_c, keys).join(at, [*keys, "c", "g"], "left")
    below = W.partitionBy(*keys, "g").orderBy("c").rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy(*keys, "c").orderBy(F.desc("g")).rowsBetween(W.unboundedPreceding, -1)
    grid = grid.select(*keys, "g", "c", *[F.sum(n).over(below).alias(n) for n in ("sm", "snm")])
    grid = grid.select(
        *keys,
        "g",
        "c",
        F.coalesce(F.sum("sm").over(above), F.lit(0)).alias("missed"),
        F.coalesce(F.sum("snm").over(above), F.lit(0)).alias("avoided"),
    ).join(ends.select(*keys, "n_sm", "n_snm"), keys)
    grid = grid.withColumn("false", F.col("n_snm") - F.col("avoided"))
    best = grid.groupBy(*keys, "n_sm", "n_snm").agg(
        F.min_by(F.struct("g", "c", "missed", "false"), F.struct(F.col("missed") + F.col("false"), "g", "c")).alias("_b")
    )
    return best.select(
        *keys,
        F.col("_b.g").alias("max_gap_um"),
        F.col("_b.c").alias("contact_vox"),
        F.col("_b.missed").alias("missed_merges"),
        F.col("_b.false").alias("false_merges"),
        F.col("n_sm").alias("n_should_merge"),
        F.col("n_snm").alias("n_should_not_merge"),
    )


def pool_samples(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recommend_merge_pooled(samples: DataFrame) -> DataFrame:
    """One recommendation over all samples together."""
    return recommend_merge(samples.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
