"""Smoothing, erosion, hole fill, contact, surface and interface operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..bricks import as_words, from_words, stencil
from ..joins import by_site, spread_join
from ..schemas import KEYS, ZYX, field_types
from .components import components, half_offsets, touching_groups


SITES = 1 << 22  # sites of the boxes whose holes are searched at once


def gaussian_weights(sigma: float) -> np.ndarray:
    """Normalised weights with radius int(4 sigma + 0.5)."""
    r = int(4.0 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return k / k.sum()


def smooth_mask(
    mask: DataFrame, volumes: DataFrame, sigma_xy: float = 1.0, sigma_z: float = 0.5, keys: Sequence[str] = KEYS, **kw
) -> DataFrame:
    """Gaussian smooth of a binary mask, mirrored at the volume edge, then > 0.5."""
    kernels = [gaussian_weights(s) for s in (sigma_z, sigma_xy, sigma_xy)]
    halo = [len(k) // 2 for k in kernels]

    def blur(dense: np.ndarray) -> np.ndarray:
        out = dense.astype("float64")
        for axis, k in enumerate(kernels):
            n = out.shape[axis] - len(k) + 1
            acc = 0.0
            for i, w in enumerate(k):
                acc = acc + w * np.take(out, range(i, i + n), axis=axis)
            out = acc
        return out > 0.5

    return stencil(mask, volumes, blur, halo, "symmetric", keys, **kw)


def _cross_erosion(axes: Sequence[int], n: int):
    def erode(dense: np.ndarray) -> np.ndarray:
        for _ in range(n):
            kept = dense.copy()
            for axis in axes:
                for shift in (1, -1):
                    kept &= np.roll(dense, shift, axis=axis)
            dense = kept
        core = tuple(slice(n, -n) if a in axes else slice(None) for a in range(3))
        return dense[core]

    return erode


def erode2d(mask: DataFrame, volumes: DataFrame, n: int, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """n steps of the 4-neighbour cross in each slice; outside the volume is background."""
    if n <= 0:
        return mask.select(*keys, *ZYX)
    return stencil(mask, volumes, _cross_erosion((1, 2), n), (0, n, n), "constant", keys, **kw)


def erode3d(mask: DataFrame, volumes: DataFrame, n: int, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """n steps of the 6-neighbour cross."""
    if n <= 0:
        return mask.select(*keys, *ZYX)
    return stencil(mask, volumes, _cross_erosion((0, 1, 2), n), (n, n, n), "constant", keys, **kw)


def z_median3(mask: DataFrame, volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Majority of slices z-1, z, z+1 with mirrored ends, taken on words; a mask given as words comes back as words.

    A line's words of all slices are dealt to one part, so they are shuffled once and vote where they are.
    """
    rows = spread_join(as_words(mask, keys), volumes.select(*keys, "nz").distinct(), keys, ["y", "w"], keep_part=True)
    at = F.explode(
        F.array(
            *[
                F.struct(F.least(F.greatest(F.col("z") + d, F.lit(0)), F.col("nz") - 1).alias("z"), F.lit(d).alias("d"))
                for d in (-1, 0, 1)
            ]
        )
    )
    votes = rows.select(*keys, "_part_no", "y", "w", "bits", at.alias("t")).groupBy(*keys, "_part_no", F.col("t.z").alias("z"), "y", "w")
    a, b, c = "_below", "_own", "_above"
    slices = [F.coalesce(F.bit_or(F.when(F.col("t.d") == d, F.col("bits"))), F.lit(0).cast("long")).alias(n) for d, n in ((1, a), (0, b), (-1, c))]
    two = F.expr(f"({a} & {b}) | ({a} & {c}) | ({b} & {c})")
    words = votes.agg(*slices).select(*keys, "z", "y", "w", two.alias("bits")).filter("bits <> 0")
    return words if "bits" in mask.columns else from_words(words, keys)


def _slice_holes(y: np.ndarray, x: np.ndarray, group: np.ndarray):
    """Enclosed 4-connected background pieces of each group (0..) of one slice: group, ys, xs, number within the group, size.

    All groups' boxes are searched together, SITES at a time.
    """
    order = np.argsort(group, kind="stable")
    y, x, group = y[order].astype("int64"), x[order].astype("int64"), group[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    n = np.diff(first, append=len(group))
    y0, y1, x0, x1 = (f.reduceat(c, first) for c in (y, x) for f in (np.minimum, np.maximum))
    # A hole has a site on each of its four sides.
    able = np.flatnonzero((n >= 4) & (y1 - y0 >= 2) & (x1 - x0 >= 2))
    width = x1 - x0 + 3
    area = (y1 - y0 + 3) * width
    out = []
    for some in np.split(able, np.flatnonzero(np.diff(np.cumsum(area[able]) // SITES)) + 1):
        if not len(some):
            continue
        start = np.cumsum(area[some]) - area[some]
        box = np.repeat(np.arange(len(some)), n[some])
        at = np.arange(len(box)) + np.repeat(first[some] - (np.cumsum(n[some]) - n[some]), n[some])
        dense = np.ones(area[some].sum(), dtype=bool)
        dense[start[box] + (y[at] - y0[some][box] + 1) * width[some][box] + x[at] - x0[some][box] + 1] = False
        empty = np.flatnonzero(dense)
        box = np.searchsorted(start, empty, "right") - 1
        by, bx = np.divmod(empty - start[box], width[some][box])
        piece = touching_groups([np.zeros_like(by), by, bx], half_offsets(4), box)
        closed = piece != piece[np.searchsorted(empty, start)][box]  # the padded corner belongs to the outside
        if not closed.any():
            continue
        box, by, bx = box[closed], by[closed], bx[closed]
        _, lead, hole, size = np.unique(piece[closed], return_index=True, return_inverse=True, return_counts=True)
        owner = box[lead]
        number = np.arange(len(lead)) - np.searchsorted(owner, owner) + 1
        out.append((group[first[some]][box], by + y0[some][box] - 1, bx + x0[some][box] - 1, number[hole], size[hole]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype="int64")] * 5


def slice_holes(mask: DataFrame, keys: Sequence[str] = KEYS, within: Sequence[str] = ()) -> DataFrame:
    """Voxels of enclosed holes per slice with their hole number and size.

    One task holds one slice of one sample, which is bounded by the frame size.
    """
    keys, within = list(keys), list(within)
    schema = T.StructType(
        [
            *field_types(mask, [*keys, *within]),
            *[T.StructField(c, T.IntegerType()) for c in (*ZYX, "hole", "hole_size")],
        ]
    )
    names = schema.names

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.groupby(within, sort=False).ngroup().to_numpy() if within else np.zeros(len(pdf), dtype="int64")
        group, ys, xs, hole, size = _slice_holes(pdf["y"].to_numpy(), pdf["x"].to_numpy(), part)
        if not len(ys):
            return pd.DataFrame(columns=names)
        _, lead = np.unique(part, return_index=True)
        out = {k: [pdf[k].iloc[0]] * len(ys) for k in keys} | {w: pdf[w].to_numpy()[lead[group]] for w in within}
        out |= {"z": pdf["z"].iloc[0], "y": ys, "x": xs, "hole": hole, "hole_size": size}
        return pd.DataFrame(out)[names]

    return mask.select(*keys, *within, *ZYX).groupBy(*keys, "z").applyInPandas(run, schema)


def fill_holes2d(mask: DataFrame, min_hole_size: int | DataFrame = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fill enclosed holes per slice: all of them, or only those below ``min_hole_size`` (a number or a table per sample)."""
    holes = slice_holes(mask, keys)
    if isinstance(min_hole_size, DataFrame):
        own = [k for k in keys if k in min_hole_size.columns]
        holes = spread_join(holes, min_hole_size.select(*own, "min_hole_size"), own, ZYX)
        holes = holes.filter((F.col("min_hole_size") <= 0) | (F.col("hole_size") < F.col("min_hole_size")))
    elif min_hole_size > 0:
        holes = holes.filter(F.col("hole_size") < min_hole_size)
    return mask.select(*keys, *ZYX).unionByName(holes.select(*keys, *ZYX))


def fill_holes3d(mask: DataFrame, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """Fill 6-connected background pockets that do not reach the outside."""
    keys = list(keys)
    box = mask.groupBy(*keys).agg(*[f(c).alias(f"{p}{c}") for c in ZYX for f, p in ((F.min, "lo"), (F.max, "hi"))])
    # Shifted by one so that the empty rim around the box keeps coordinates >= 0.
    empty = box.withColumn("z", F.explode(F.expr("sequence(loz, hiz + 2)")))
    empty = empty.withColumn("y", F.explode(F.expr("sequence(loy, hiy + 2)"))).repartition(*keys, "z", "y")
    empty = empty.withColumn("x", F.explode(F.expr("sequence(lox, hix + 2)")))
    solid = mask.select(*keys, *[(F.col(c) + 1).alias(c) for c in ZYX])
    empty = empty.select(*keys, *ZYX).join(by_site(solid), [*keys, *ZYX], "left_anti")
    found = components(empty, keys, 6, **kw)
    # The outside piece holds the lowest corner of the rim.
    outside = found.groupBy(*keys).agg(F.min("component").alias("outside"))
    pockets = spread_join(found, outside, keys, ZYX).filter("component <> outside")
    return mask.select(*keys, *ZYX).unionByName(pockets.select(*keys, *[(F.col(c) - 1).alias(c) for c in ZYX]))


def face_pairs(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Face-adjacent voxel pairs with different labels: coordinates and label of both sides."""
    keys = list(keys)
    step = F.explode(
        F.array(*[F.struct(*[F.lit(int(a == b)).alias(b) for b in ZYX]) for a in ZYX])
    )
    ahead = labels.select(*keys, *ZYX, F.col("label").alias("label_a"), step.alias("_o"))
    ahead = ahead.select(
        *keys, "label_a", *[F.col(c).alias(f"{c}_a") for c in ZYX], *[(F.col(c) + F.col(f"_o.{c}")).alias(c) for c in ZYX]
    )
    other = labels.select(*keys, *ZYX, F.col("label").alias("label_b"))
    return ahead.join(by_site(other), [*keys, *ZYX]).filter("label_a <> label_b").withColumnsRenamed({c: f"{c}_b" for c in ZYX})


def contact(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Asymmetric contact: voxels of ``target`` that share a face with ``source``."""
    keys = list(keys)
    pairs = face_pairs(labels, keys)
    both = pairs.select(
        *keys, F.col("label_a").alias("source"), F.col("label_b").alias("target"), *[F.col(f"{c}_b").alias(c) for c in ZYX]
    ).unionByName(
        pairs.select(
            *keys, F.col("label_b").alias("source"), F.col("label_a").alias("target"), *[F.col(f"{c}_a").alias(c) for c in ZYX]
        )
    )
    return both.distinct().groupBy(*keys, "source", "target").agg(F.count("*").alias("contact"))


def surface(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Voxels with fewer than six face neighbours of their own label."""
    keys = list(keys)
    steps = [(0, 0, 0)] + [s for o in half_offsets(6) for s in (o, tuple(-v for v in o))]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, ZYX)]) for s in steps]))
    seen = labels.select(*keys, "label", *ZYX, step.alias("_o")).select(
        *keys,
        "label",
        *[(F.col(c) + F.col(f"_o.{c}")).alias(c) for c in ZYX],
        (F.abs("_o.z") + F.abs("_o.y") + F.abs("_o.x")).alias("_d"),
    )
    # One pass: a site is own (distance 0) and is counted by each like-labelled neighbour.
    sites = seen.groupBy(*keys, "label", *ZYX).agg(F.min("_d").alias("_own"), F.count("*").alias("_n"))
    return sites.filter("_own = 0 and _n < 7").select(*keys, *ZYX, "label")


def interface_cut(parts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop both voxels of every face-adjacent pair that lies in different parts."""
    pairs = face_pairs(parts, keys)
    cut = pairs.select(*keys, *[F.col(f"{c}_a").alias(c) for c in ZYX]).unionByName(
        pairs.select(*keys, *[F.col(f"{c}_b").alias(c) for c in ZYX])
    )
    return parts.join(cut.distinct(), [*keys, *ZYX], "left_anti")


def thin_weights(mask: DataFrame, volumes: DataFrame, radius: int, boost: float, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """Per-slice weight map: 1 + boost where the mask vanishes within ``radius`` square erosions."""
    n = int(radius)

    def survive(dense: np.ndarray) -> np.ndarray:
        for _ in range(n):
            for axis in (1, 2):
                dense = dense & np.roll(dense, 1, axis) & np.roll(dense, -1, axis)
        return dense[:, n:-n, n:-n] if n else dense

    # Erosion by max-pooling treats the frame edge as neutral, so edges repeat outward.
    thick = stencil(mask, volumes, survive, (0, n, n), "edge", keys, **kw).withColumn("_thick", F.lit(True))
    return mask.select(*keys, *ZYX).join(by_site(thick), [*keys, *ZYX], "left").select(
        *keys, *ZYX, F.when(F.col("_thick"), F.lit(1.0)).otherwise(F.lit(1.0 + boost)).alias("weight")
    )
