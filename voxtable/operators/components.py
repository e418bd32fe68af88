"""Run encoding, connected components and overlap linking.

Components are found in two steps. Inside a bounded brick of the lattice one
task joins touching voxels; across brick faces only the voxels on the faces
are compared, and the few pieces they connect are grouped by ``graph.connected``.
A hot sample is therefore spread over its bricks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..bricks import BRICK
from ..graph import connected
from ..joins import by_site
from ..schemas import KEYS, ZYX, field_types
from ..session import is_empty, materialize

BITS = 21  # bits per axis in a packed voxel id; raster order is numeric order


def half_offsets(conn: int) -> list[tuple[int, int, int]]:
    """The forward half of a neighbourhood: 4/8 stay in the slice, 6/26 cross slices."""
    reach = {4: 1, 8: 2, 6: 1, 26: 3}[conn]
    dz = (0,) if conn in (4, 8) else (-1, 0, 1)
    every = [(a, b, c) for a in dz for b in (-1, 0, 1) for c in (-1, 0, 1)]
    return [o for o in every if o > (0, 0, 0) and sum(map(abs, o)) <= reach]


def voxel_id(prefix: str = ""):
    return (
        F.shiftleft(F.col(prefix + "z").cast("long"), 2 * BITS)
        + F.shiftleft(F.col(prefix + "y").cast("long"), BITS)
        + F.col(prefix + "x").cast("long")
    )


def encode_runs(voxels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gaps-and-islands: one row (z, y, x0, x1 inclusive) per unbroken run along x."""
    row = W.partitionBy(*keys, "z", "y").orderBy("x")
    island = voxels.withColumn("_i", F.col("x") - F.row_number().over(row))
    return island.groupBy(*keys, "z", "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")


def union_pieces(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lowest member index of each group of 0..n-1 joined by the given pairs."""
    low = np.arange(n)
    while True:
        a, b = low[left], low[right]
        apart = a != b
        if not apart.any():
            return low
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while True:
            hop = low[low]
            if np.array_equal(hop, low):
                break
            low = hop


def touching_groups(coords: list[np.ndarray], offsets, group: np.ndarray | None = None) -> np.ndarray:
    """For each voxel the index of the first voxel (input order) of its connected piece."""
    n = len(coords[0])
    base = [int(c.min()) for c in coords]
    width = [int(c.max()) - b + 3 for c, b in zip(coords, base)]
    z, y, x = (c.astype("int64") - b + 1 for c, b in zip(coords, base))
    code = (z * width[1] + y) * width[2] + x
    if group is not None:
        code = code + group.astype("int64") * (width[0] * width[1] * width[2])
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    left, right = [], []
    for dz, dy, dx in offsets:
        want = ranked + ((dz * width[1] + dy) * width[2] + dx)
        at = np.searchsorted(ranked, want)
        hit = np.nonzero((at < n) & (ranked[np.minimum(at, n - 1)] == want))[0]
        left.append(hit)
        right.append(at[hit])
    low = union_pieces(n, np.concatenate(left), np.concatenate(right))
    out = np.empty(n, dtype="int64")
    out[order] = order[low]
    return out


def components(
    voxels: DataFrame,
    keys: Sequence[str] = KEYS,
    conn: int = 26,
    within: Sequence[str] = (),
    brick: Sequence[int] = BRICK,
    name: str = "component",
) -> DataFrame:
    """Add the id of each voxel's connected piece: the packed id of its raster-first voxel.

    ``within`` columns must agree for two voxels to be joined (for example the
    label, to find the pieces of each label).
    """
    keys, within = list(keys), list(within)
    offsets = half_offsets(conn)
    bs = [int(b) for b in brick]
    cols = [*keys, *within, *ZYX]
    schema = T.StructType(
        [*field_types(voxels, cols), *[T.StructField(f"b{c}", T.IntegerType()) for c in ZYX], T.StructField(name, T.LongType())]
    )
    bricked = voxels.select(*cols)
    for c, b in zip(ZYX, bs):
        bricked = bricked.withColumn(f"b{c}", F.floor(F.col(c) / b).cast("int"))

    def label_brick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(ZYX), kind="stable", ignore_index=True)
        group = pdf.groupby(within, dropna=False, sort=False).ngroup().to_numpy() if within else None
        z, y, x = (pdf[c].to_numpy() for c in ZYX)
        first = touching_groups([z, y, x], offsets, group)
        packed = (z.astype("int64") << 2 * BITS) + (y.astype("int64") << BITS) + x
        pdf[name] = packed[first]
        return pdf

    local = bricked.groupBy(*keys, "bz", "by", "bx").applyInPandas(label_brick, schema)
    local = materialize(local, "bricks")

    # Pairs across brick faces: shift face voxels by each offset that leaves the brick.
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip(o, ZYX)]) for o in offsets]))
    rim = None
    for c, b in zip(ZYX, bs):
        on_face = F.pmod(F.col(c), F.lit(b)).isin(0, b - 1)
        rim = on_face if rim is None else rim | on_face
    leaving = local.filter(rim).withColumn("_o", step)
    crosses = None
    for c, b in zip(ZYX, bs):
        out = F.floor((F.col(c) + F.col(f"_o.d{c}")) / b) != F.col(f"b{c}")
        crosses = out if crosses is None else crosses | out
    leaving = leaving.filter(crosses).select(
        *keys, *within, *[(F.col(c) + F.col(f"_o.d{c}")).alias(c) for c in ZYX], F.col(name).alias("a")
    )
    faces = local.filter(rim).select(*keys, *within, *ZYX, F.col(name).alias("b"))
    scope = [*keys, *within]
    pairs = leaving.join(by_site(faces), [*scope, *ZYX]).select(*scope, "a", "b").distinct()
    pairs = materialize(pairs, "faces")
    local = local.drop("bz", "by", "bx")
    if is_empty(pairs):
        return local
    roots = connected(pairs, scope).select(*scope, F.col("node").alias(name), "root")
    return (
        local.join(roots, [*scope, name], "left")
        .withColumn(name, F.coalesce("root", name))
        .drop("root")
    )


def label_components(voxels: DataFrame, keys: Sequence[str] = KEYS, conn: int = 26, **kw) -> DataFrame:
    """Components numbered 1..N per sample in raster order of their first voxel."""
    from ..numbering import number_rows

    found = components(voxels, keys, conn, **kw)
    ids = number_rows(found.select(*keys, "component").distinct(), keys, [F.col("component")], "label")
    return found.join(ids, [*keys, "component"]).select(*keys, *ZYX, "label")


def largest_component(found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Voxels of the biggest component per sample; ties go to the raster-first one."""
    sizes = found.groupBy(*keys, "component").count()
    best = sizes.groupBy(*keys).agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("component"))
    return found.join(best, [*keys, "component"], "left_semi")


def overlap_link(labels2d: DataFrame, pct: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Link per-slice objects of neighbouring slices when shared / smaller area >= pct.

    Input: z, y, x, label (unique per slice, any long). Output: z, label, group, where the
    group is the struct (z, label) of its first member.
    """
    keys = list(keys)
    node = F.struct(F.col("z").cast("long").alias("z"), F.col("label").cast("long").alias("label")).alias("node")
    px = labels2d.select(*keys, *ZYX, "label", node)
    area = px.groupBy(*keys, "node").agg(F.count("*").alias("area"))
    below = px.select(*keys, (F.col("z") + 1).alias("z"), "y", "x", F.col("node").alias("a"))
    shared = (
        px.withColumnRenamed("node", "b").join(below, [*keys, *ZYX]).groupBy(*keys, "a", "b").agg(F.count("*").alias("shared"))
    )
    linked = (
        shared.join(area.withColumnsRenamed({"node": "a", "area": "area_a"}), [*keys, "a"])
        .join(area.withColumnsRenamed({"node": "b", "area": "area_b"}), [*keys, "b"])
        .filter(F.col("shared") / F.least("area_a", "area_b") >= pct)
    )
    roots = connected(linked, keys)
    objs = px.select(*keys, "z", "label", "node").distinct()
    return objs.join(roots, [*keys, "node"], "left").select(
        *keys, "z", "label", F.coalesce("root", "node").alias("group")
    )
