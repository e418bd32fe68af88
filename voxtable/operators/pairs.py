"""Joins between objects: proximity, nearest neighbours, density, surface gaps, fragments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..joins import by_site, spread_join
from ..schemas import KEYS, ZYX, field_types
from ..session import is_empty, materialize
from .objects import object_info
from .stencils import contact, surface

CELL = 32  # voxels per side of the lookup grid
GAP_CELL = 8  # voxels per side of the pruning cells of the gap search
CROWD = 64  # points a neighbour-search cell may hold at the start
COMPANY = 6  # points in the cell of the mean point at the start
HALVINGS = 6  # how often the starting cell width may be halved
FEW = 1 << 16  # point pairs that a pair of density cells may stand for and still be compared point by point
FINER = 4  # how often density cells may be halved
LISTED = 256  # points of a density cell that travel as one list
BLOCK = 3  # cells per side of the block in which a neighbour search meets


def joint_bbox(a: str = "a_", b: str = "b_") -> list[Column]:
    """z0..x1 of the box around both boxes."""
    low = [F.least(f"{a}{c}0", f"{b}{c}0").alias(f"{c}0") for c in ZYX]
    return low + [F.greatest(f"{a}{c}1", f"{b}{c}1").alias(f"{c}1") for c in ZYX]


def _prefixed(objs: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return objs.select(*keys, *[F.col(c).alias(prefix + c) for c in objs.columns if c not in keys])


def bbox_pairs(a: DataFrame, b: DataFrame, margin: float | Column = 0, keys: Sequence[str] = KEYS, cell: int = CELL) -> DataFrame:
    """Pairs whose boxes come within ``margin`` voxels on every axis; columns a_*, b_*.

    Each box is listed in the grid cells it covers (the a side widened by the
    margin, which may be an expression over ``a``); boxes meet in a shared cell.
    A pair is kept only in the first cell both cover, so no distinct is needed.
    """
    keys = list(keys)
    margin = margin if isinstance(margin, Column) else F.lit(float(margin))

    def spread(df: DataFrame, p: str, m: Column) -> DataFrame:
        for c in ZYX:
            lo = F.floor((F.col(f"{p}{c}0") - m) / cell)
            hi = F.floor((F.col(f"{p}{c}1") + m) / cell)
            df = df.withColumn(f"{p}g{c}", lo.cast("int")).withColumn(f"g{c}", F.explode(F.sequence(lo, hi)))
        return df

    left = spread(_prefixed(a.withColumn("_m", margin), keys, "a_"), "a_", F.col("a__m"))
    right = spread(_prefixed(b, keys, "b_"), "b_", F.lit(0.0))
    both = left.join(right, [*keys, "gz", "gy", "gx"])
    for c in ZYX:
        both = both.filter(F.col(f"g{c}") == F.greatest(f"a_g{c}", f"b_g{c}"))
        both = both.filter(f"not (a_{c}1 + a__m < b_{c}0 or b_{c}1 + a__m < a_{c}0)")
    return both.drop("a__m", *[f"{p}g{c}" for p in ("", "a_", "b_") for c in ZYX])


def _dist2(a: str, b: str) -> Column:
    total = F.lit(0.0)
    for c in ZYX:
        step = F.col(f"{a}{c}") - F.col(f"{b}{c}")
        total = total + step * step
    return total


def _in_blocks(df: DataFrame, cell: str, wide: bool) -> DataFrame:
    """Rows with the block (gz, gy, gx) of their cell, or repeated for each block that the cells around theirs lie in."""
    for c in ZYX:
        h = F.col(f"{cell}{c}")
        low, high = F.floor((h - 1) / BLOCK), F.floor((h + 1) / BLOCK)
        df = df.withColumn(f"g{c}", F.explode(F.sequence(low, high)) if wide else F.floor(h / BLOCK))
    return df


def knn(points: DataFrame, k: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """k nearest other points per point: label, rank, nn_label, dist. Ties go to the lower label.

    ``points``: label, z, y, x (doubles). Each round looks in the 27 grid cells
    around a point; a neighbour list is final once its k-th distance fits in one
    cell width. Points left over look again with cells twice as wide, until a
    cell spans the sample. Points meet in blocks of BLOCK cells a side. At first
    each block also gets the cells around it, so all candidates of a point meet in
    one task and only its k nearest leave it; later the few points left over go to
    the blocks they look into.
    """
    keys = list(keys)
    pts = points.select(*keys, "label", *[F.col(c).cast("double").alias(c) for c in ZYX])
    spans = [(F.max(c) - F.min(c)) for c in ZYX]
    stat = pts.groupBy(*keys).agg(F.count("*").alias("_n"), F.greatest(*spans).alias("_span"))
    # About two points per cell if they fill their box evenly. Where points crowd, the
    # width is halved until no cell holds more than CROWD of them and the mean point's holds COMPANY at most.
    even = F.greatest(F.col("_span") / F.greatest(F.cbrt(F.col("_n") / 2.0), F.lit(1.0)), F.lit(1e-6))
    pts = spread_join(pts, stat.withColumn("_even", even), keys, ["label"])
    level = pts.withColumn("_l", F.explode(F.expr(f"sequence(0, {HALVINGS})"))).withColumn("_w", F.col("_even") / F.pow(F.lit(2.0), "_l"))
    full = level.groupBy(*keys, "_l", "_w", *[F.floor(F.col(c) / F.col("_w")).alias(f"h{c}") for c in ZYX]).count()
    full = full.groupBy(*keys, "_l", "_w").agg(
        F.max("count").alias("_most"), (F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("_mean")
    )
    loose = (F.col("_most") <= CROWD) & (F.col("_mean") <= COMPANY)
    width = full.groupBy(*keys).agg(F.coalesce(F.max(F.when(loose, F.col("_w"))), F.min("_w")).alias("_start"))
    pts = materialize(spread_join(pts.drop("_even"), width, keys, ["label"]), "points")
    start = F.col("_start")
    open_pts, done, factor = pts, None, 1.0
    while True:
        w = start * factor
        cells = [F.floor(F.col(c) / w) for c in ZYX]
        around = open_pts.filter("_n > 1").select(
            *keys, F.col("label").alias("a_label"), *[F.col(c).alias(f"a_{c}") for c in ZYX], "_n", "_span", w.alias("_w"), *[
                v.alias(f"a_h{c}") for v, c in zip(cells, ZYX)
            ]
        )
        others = pts.select(
            *keys, F.col("label").alias("b_label"), *[F.col(c).alias(f"b_{c}") for c in ZYX], *[
                v.alias(f"b_h{c}") for v, c in zip(cells, ZYX)
            ]
        )
        around, others = _in_blocks(around, "a_h", done is not None), _in_blocks(others, "b_h", done is None)
        near = around.join(by_site(others), [*keys, "gz", "gy", "gx"]).filter("a_label <> b_label")
        for c in ZYX:
            near = near.filter(F.abs(F.col(f"a_h{c}") - F.col(f"b_h{c}")) <= 1)
        near = near.withColumn("dist", F.sqrt(_dist2("a_", "b_")))
        rank = F.row_number().over(W.partitionBy(*keys, "a_label").orderBy("dist", "b_label"))
        near = near.withColumn("rank", rank).filter(F.col("rank") <= k)
        want = F.least(F.lit(k), F.col("_n") - 1)
        final = near.groupBy(*keys, "a_label").agg(
            F.max("dist").alias("_far"), F.count("*").alias("_got"), F.first("_w").alias("_w"), F.first(want).alias("_k"),
            F.first("_span").alias("_span"),
            F.sort_array(F.collect_list(F.struct("rank", F.col("b_label").alias("nn_label"), "dist"))).alias("_nn"),
        )
        final = final.filter("(_got >= _k and _far <= _w) or _w > _span")
        final = materialize(final.select(*keys, F.col("a_label").alias("label"), "_nn"), "knn")
        done = final if done is None else done.unionByName(final)
        open_pts = materialize(open_pts.filter("_n > 1").join(final, [*keys, "label"], "left_anti"), "open")
        if is_empty(open_pts):
            break
        factor *= 2.0
    rows = done.select(*keys, "label", F.explode("_nn").alias("_e"))
    return rows.select(*keys, "label", "_e.rank", "_e.nn_label", "_e.dist")


def nearest_two(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First and second neighbour per point; a lone second falls back to the first, a lone point to itself."""
    nn = knn(points, 2, keys).groupBy(*keys, "label").agg(
        *[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"_{c}{r}") for r in (1, 2) for c in ("nn_label", "dist")]
    )
    out = points.select(*keys, "label").join(nn, [*keys, "label"], "left")
    one, far = F.coalesce("_nn_label1", "label"), F.coalesce("_dist1", F.lit(0.0))
    return out.select(
        *keys,
        "label",
        one.alias("nearest_neighbor_label"),
        far.alias("nearest_neighbor_dist_um"),
        F.coalesce("_nn_label2", one).alias("nearest_neighbor_2_label"),
        F.coalesce("_dist2", far).alias("nearest_neighbor_2_dist_um"),
    )


def _counter(radius: float, keys: Sequence[str], schema: T.StructType):
    """For rows of two point lists: how many points of the second lie within ``radius`` of each point of the first."""

    def run(parts):
        for pdf in parts:
            if pdf.empty:
                continue
            found, sides = [], [pdf[f"{p}_{c}"].to_numpy() for c in ZYX for p in "ab"]
            for az, bz, ay, by, ax, bx in zip(*sides):
                d2 = np.square(az[:, None] - bz)
                d2 += np.square(ay[:, None] - by)
                d2 += np.square(ax[:, None] - bx)
                found.append((np.sqrt(d2) <= radius).sum(axis=1))
            length = [len(n) for n in found]
            out = {k: np.repeat(pdf[k].to_numpy(), length) for k in keys}
            yield pd.DataFrame({**out, "label": np.concatenate(pdf["a_label"].to_numpy()), "_n": np.concatenate(found)})[schema.names]

    return run


def radius_count(points: DataFrame, radius: float = 100.0, keys: Sequence[str] = KEYS, split: int = 4) -> DataFrame:
    """Other points within ``radius`` (inclusive) of each point.

    Points are summarised in cells of radius/split. A pair of cells that lies
    wholly inside the radius adds the cell's count. A pair cut by the sphere is
    halved as long as it stands for more than FEW point pairs, FINER times at
    most; what is then still cut is compared point by point, on lists of at most about LISTED points a side.
    """
    keys = list(keys)
    home = [f"h{c}" for c in ZYX]
    pts = points.select(*keys, "label", *[F.col(c).cast("double").alias(c) for c in ZYX])
    box = [f"{p}{c}" for c in ZYX for p in ("lo", "hi")]

    def at(width: float) -> DataFrame:
        return pts.select("*", *[F.floor(F.col(c) / width).alias(h) for c, h in zip(ZYX, home)])

    def cells_of(width: float) -> DataFrame:
        return at(width).groupBy(*keys, *home).agg(
            F.count("*").alias("n"), *[f(c).alias(f"{p}{c}") for c in ZYX for f, p in ((F.min, "lo"), (F.max, "hi"))]
        )

    def side(cells: DataFrame, p: str) -> DataFrame:
        return cells.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in cells.columns if c not in keys])

    def measured(duo: DataFrame) -> DataFrame:
        near, far = F.lit(0.0), F.lit(0.0)
        for c in ZYX:
            gap = F.greatest(
                F.col(f"b_lo{c}") - F.col(f"a_hi{c}"), F.col(f"a_lo{c}") - F.col(f"b_hi{c}"), F.lit(0.0)
            )
            reach = F.greatest(F.col(f"b_hi{c}") - F.col(f"a_lo{c}"), F.col(f"a_hi{c}") - F.col(f"b_lo{c}"))
            near, far = near + gap * gap, far + reach * reach
        named = [f"{p}_{c}" for p in "ab" for c in (*home, "n")]
        return duo.filter(F.sqrt(near) <= radius).select(*keys, *named, (F.sqrt(far) <= radius).alias("sure"))

    count = T.StructType([*field_types(points, [*keys, "label"]), T.StructField("_n", T.LongType())])
    out, width = pts.select(*keys, "label"), radius / split
    cells = cells_of(width)
    block = [F.floor(F.col(h) / (split + 1)).alias(f"g{c}") for h, c in zip(home, ZYX)]
    a = side(cells, "a").select("*", *[F.floor(F.col(f"a_{h}") / (split + 1)).alias(f"g{c}") for h, c in zip(home, ZYX)])
    for c in ZYX:
        a = a.withColumn(f"g{c}", F.explode(F.expr(f"sequence(g{c} - 1, g{c} + 1)")))
    b = side(cells.select("*", *block), "b").withColumnsRenamed({f"b_g{c}": f"g{c}" for c in ZYX})
    duo = materialize(measured(a.join(by_site(b), [*keys, "gz", "gy", "gx"])), "cell-pairs")
    counts = None
    for level in range(FINER + 1):
        whole = duo.filter("sure").groupBy(*keys, *[F.col(f"a_{h}").alias(h) for h in home]).agg(F.sum("b_n").alias("_n"))
        inside = at(width).join(by_site(whole), [*keys, *home]).select(*keys, "label", "_n")
        counts = inside if counts is None else counts.unionByName(inside)
        few = F.lit(True) if level == FINER else F.col("a_n") * F.col("b_n") <= FEW
        ends = duo.filter(~F.col("sure") & few).select(*keys, *[f"{p}_{h}" for p in "ab" for h in home])
        size = cells.select(*keys, *home, "n")
        listed = at(width).join(by_site(size), [*keys, *home]).withColumn("_k", F.pmod(F.xxhash64("label"), F.floor(F.col("n") / LISTED) + 1))
        listed = listed.groupBy(*keys, *home, "_k").agg(F.collect_list(F.struct("label", *ZYX)).alias("_p"))
        for p in "ab":
            one = listed.select(*keys, *[F.col(h).alias(f"{p}_{h}") for h in home], *[F.col(f"_p.{c}").alias(f"{p}_{c}") for c in ("label", *ZYX)])
            ends = ends.join(by_site(one), [*keys, *[f"{p}_{h}" for h in home]])
        ends = ends.select(*keys, *[f"{p}_{c}" for p in "ab" for c in ("label", *ZYX)])
        met = ends.mapInPandas(_counter(radius, keys, count), count).groupBy(*keys, "label").agg(F.sum("_n").alias("_n"))
        counts = counts.unionByName(met)
        more = duo.filter(~F.col("sure") & ~few)
        if level == FINER or is_empty(more):
            break
        # Both cells of a pair give way to their halves.
        width /= 2.0
        more = more.select(*keys, *[F.col(f"{p}_{h}").alias(f"{p}_up_{h}") for p in "ab" for h in home])
        cells = cells_of(width)
        for p in "ab":
            child = side(cells, p).select("*", *[F.floor(F.col(f"{p}_{h}") / 2).alias(f"{p}_up_{h}") for h in home])
            more = more.join(by_site(child), [*keys, *[f"{p}_up_{h}" for h in home]])
        duo = materialize(measured(more), "cell-pairs")
    total = counts.groupBy(*keys, "label").agg(F.sum("_n").alias("_n"))
    return out.join(total, [*keys, "label"], "left").select(*keys, "label", (F.coalesce("_n", F.lit(0)) - 1).alias("n_within"))


def gaps(labels: DataFrame, pairs: DataFrame, scales: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Smallest centre-to-centre distance (um) between the surfaces of each (a, b) pair.

    Branch and bound as joins: surfaces are summarised in small cells; only cell
    pairs whose lower bound does not exceed the pair's best upper bound are
    opened to voxels. ``pairs``: a, b; ``scales``: sz, sy, sx.
    """
    keys = list(keys)
    named = pairs.select(*keys, F.explode(F.array("a", "b")).alias("label")).distinct()
    skin = surface(labels.join(named, [*keys, "label"], "left_semi"), keys)
    skin = spread_join(skin, scales.select(*keys, "sz", "sy", "sx"), keys, ZYX)
    skin = skin.select(
        *keys,
        "label",
        *[(F.col(c) * F.col(f"s{c}")).alias(c) for c in ZYX],
        *[F.floor(F.col(c) / GAP_CELL).alias(f"g{c}") for c in ZYX],
    )
    skin = materialize(skin, "skin")
    home = ["gz", "gy", "gx"]
    cells = skin.groupBy(*keys, "label", *home).agg(
        F.min(F.struct(*ZYX)).alias("rep"), *[f(c).alias(f"{p}{c}") for c in ZYX for f, p in ((F.min, "lo"), (F.max, "hi"))]
    )
    ca = cells.select(*keys, *[F.col(c).alias(f"a_{c}" if c != "label" else "a") for c in cells.columns if c not in keys])
    cb = cells.select(*keys, *[F.col(c).alias(f"b_{c}" if c != "label" else "b") for c in cells.columns if c not in keys])
    # Pairs and cells are packed well on disk and many times larger in memory: they are merged, not broadcast.
    duo = pairs.select(*keys, "a", "b").distinct().join(by_site(ca), [*keys, "a"]).join(by_site(cb), [*keys, "b"])
    low, high = F.lit(0.0), F.lit(0.0)
    for c in ZYX:
        gap = F.greatest(F.col(f"b_lo{c}") - F.col(f"a_hi{c}"), F.col(f"a_lo{c}") - F.col(f"b_hi{c}"), F.lit(0.0))
        step = F.col(f"a_rep.{c}") - F.col(f"b_rep.{c}")
        low, high = low + gap * gap, high + step * step
    duo = duo.select(
        *keys, "a", "b", *[F.col(f"{p}_{h}") for p in "ab" for h in home], low.alias("_low"), high.alias("_high")
    )
    duo = materialize(duo, "cells")
    best = duo.groupBy(*keys, "a", "b").agg(F.min("_high").alias("_best"))
    open_ = duo.join(by_site(best), [*keys, "a", "b"]).filter(F.col("_low") <= F.col("_best") * (1 + 1e-9))
    va = skin.select(*keys, F.col("label").alias("a"), *[F.col(c).alias(f"a_{c}") for c in (*ZYX, *home)])
    vb = skin.select(*keys, F.col("label").alias("b"), *[F.col(c).alias(f"b_{c}") for c in (*ZYX, *home)])
    near = open_.join(by_site(va), [*keys, "a", *[f"a_{h}" for h in home]])
    near = near.join(by_site(vb), [*keys, "b", *[f"b_{h}" for h in home]])
    return near.groupBy(*keys, "a", "b").agg(F.sqrt(F.min(_dist2("a_", "b_"))).alias("gap_um"))


def gap_contact(labels: DataFrame, pairs: DataFrame, scales: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """gap_um and contact_vox (voxels of b that touch a) for each (a, b) pair."""
    touch = contact(labels, keys).select(
        *keys, F.col("source").alias("a"), F.col("target").alias("b"), F.col("contact").cast("int").alias("contact_vox")
    )
    out = gaps(labels, pairs, scales, keys).join(touch, [*keys, "a", "b"], "left")
    return out.withColumn("contact_vox", F.coalesce("contact_vox", F.lit(0)))


def intercell_gaps(labels: DataFrame, volumes: DataFrame, pad_um: float = 15.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gap of every pair a < b where b has voxels inside a's box padded by ``pad_um``."""
    keys = list(keys)
    objs = spread_join(object_info(labels, keys), volumes.select(*keys, "sz", "sy", "sx"), keys, ["label"])
    for c in ZYX:
        pad = F.ceil(F.lit(float(pad_um)) / F.col(f"s{c}"))
        objs = objs.withColumn(f"{c}0", (F.col(f"{c}0") - pad).cast("int")).withColumn(
            f"{c}1", (F.col(f"{c}1") + pad).cast("int")
        )
    boxes = objs.select(*keys, F.col("label").alias("a"), *[f"{c}{e}" for c in ZYX for e in "01"])
    boxes = materialize(boxes, "boxes")
    b_cells = labels.select(*keys, F.col("label").alias("b"), *ZYX, *[F.floor(F.col(c) / CELL).alias(f"g{c}") for c in ZYX])
    # Whole cells first: one row per (b, cell) with the box of b's voxels there.
    tight = b_cells.groupBy(*keys, "b", "gz", "gy", "gx").agg(
        *[f(c).alias(f"{p}{c}") for c in ZYX for f, p in ((F.min, "lo"), (F.max, "hi"))]
    )
    listed = boxes
    for c in ZYX:
        listed = listed.withColumn(
            f"g{c}",
            F.explode(F.sequence(F.floor(F.col(f"{c}0") / CELL), F.floor((F.col(f"{c}1") - 1) / CELL))),
        )
    meet = listed.join(tight, [*keys, "gz", "gy", "gx"]).filter("a < b")
    for c in ZYX:
        meet = meet.filter(f"lo{c} < {c}1 and hi{c} >= {c}0")
    inside = " and ".join(f"lo{c} >= {c}0 and hi{c} < {c}1" for c in ZYX)
    sure = meet.filter(inside).select(*keys, "a", "b")
    unsure = meet.filter(f"not ({inside})")
    checked = unsure.join(b_cells, [*keys, "b", "gz", "gy", "gx"])
    for c in ZYX:
        checked = checked.filter(f"{c} >= {c}0 and {c} < {c}1")
    found = materialize(sure.unionByName(checked.select(*keys, "a", "b")).distinct(), "near")
    measured = materialize(gaps(labels, found, volumes, keys), "gaps")
    # Beyond the pad the nearest voxel of b may lie outside the box; there only b's voxels inside it count.
    far = measured.filter(F.col("gap_um") > pad_um).select(*keys, "a", "b")
    if is_empty(far):
        return measured
    box = boxes.select(*keys, "a", *[f"{c}{e}" for c in ZYX for e in "01"]).distinct()
    part = far.join(labels.select(*keys, F.col("label").alias("b"), *ZYX), [*keys, "b"]).join(box, [*keys, "a"])
    for c in ZYX:
        part = part.filter(f"{c} >= {c}0 and {c} < {c}1")
    scope = [*keys, "a", "b"]
    whole = far.join(labels.select(*keys, F.col("label").alias("a"), *ZYX), [*keys, "a"])
    both = whole.select(*scope, *ZYX, F.lit(1).alias("label")).unionByName(part.select(*scope, *ZYX, F.lit(2).alias("label")))
    scale = far.join(volumes.select(*keys, "sz", "sy", "sx"), keys)
    duo = far.withColumnsRenamed({"a": "_ka", "b": "_kb"}).withColumns({"a": F.lit(1), "b": F.lit(2)})
    keyed = [*keys, "_ka", "_kb"]
    names = {"a": "_ka", "b": "_kb"}
    cut = gaps(both.withColumnsRenamed(names), duo, scale.withColumnsRenamed(names), keyed)
    cut = cut.select(*keys, F.col("_ka").alias("a"), F.col("_kb").alias("b"), "gap_um")
    return measured.join(far, scope, "left_anti").unionByName(cut)


def min_intercell_gap(labels: DataFrame, volumes: DataFrame, pad_um: float = 15.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Smallest gap, its pair (first in label order on ties) and the number of pairs measured."""
    g = intercell_gaps(labels, volumes, pad_um, keys)
    return g.groupBy(*keys).agg(
        F.min("gap_um").alias("min_gap_um"),
        F.min_by("a", F.struct("gap_um", "a", "b")).alias("label_a"),
        F.min_by("b", F.struct("gap_um", "a", "b")).alias("label_b"),
        F.count("*").alias("n_pairs_measured"),
    )


def overlap(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = KEYS, by: Sequence[str] = ()) -> DataFrame:
    """Shared voxels per (gt, pred) pair, from one equi-join on coordinates."""
    p = pred.select(*keys, *by, *ZYX, F.col("label").alias("pred"))
    g = gt.select(*keys, *ZYX, F.col("label").alias("gt"))
    return p.join(g, [*keys, *ZYX]).groupBy(*keys, *by, "gt", "pred").agg(F.count("*").alias("inter"))


def assign_fragments(pred: DataFrame, gt: DataFrame, min_overlap: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each fragment's most-overlapped cell (ties: lowest id) if it reaches ``min_overlap`` voxels."""
    top = overlap(pred, gt, keys).groupBy(*keys, "pred").agg(
        F.max_by(F.struct("gt", "inter"), F.struct("inter", -F.col("gt"))).alias("_t")
    )
    return top.select(*keys, F.col("pred").alias("label"), "_t.gt", "_t.inter").filter(F.col("inter") >= min_overlap)


def should_merge_samples(pred, assigned, scales, keys: Sequence[str] = KEYS) -> DataFrame:
    """One (gap, contact) row per fragment: its nearest sibling in the same cell."""
    a = assigned.select(*keys, "gt", F.col("label").alias("a"))
    b = assigned.select(*keys, "gt", F.col("label").alias("b"))
    pairs = a.join(b, [*keys, "gt"]).filter("a <> b").select(*keys, "a", "b")
    gc = gap_contact(pred, pairs, scales, keys)
    return gc.groupBy(*keys, F.col("a").alias("label")).agg(
        F.min("gap_um").alias("gap_um"), F.min_by("contact_vox", F.struct("gap_um", "b")).alias("contact_vox")
    )


def should_not_merge_samples(pred, assigned, scales, pad_um: float = 3.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(gap, contact) of every near pair a < b of fragments from different cells."""
    keys = list(keys)
    info = object_info(pred, keys).join(assigned.select(*keys, "label", "gt"), [*keys, "label"])
    pad = scales.select(*keys, (F.lit(float(pad_um)) / F.least("sz", "sy", "sx")).alias("pad"))
    info = spread_join(info, pad, keys, ["label"])
    near = bbox_pairs(info, info, F.col("pad"), keys).filter("a_label < b_label and a_gt <> b_gt")
    pairs = materialize(near.select(*keys, F.col("a_label").alias("a"), F.col("b_label").alias("b")), "pairs")
    return gap_contact(pred, pairs, scales, keys)
