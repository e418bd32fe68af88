"""Tiled scoring with Gaussian blending of overlapping tiles. The predictor is the user's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schemas import KEYS, ZYX, field_types


def tile_starts(size: str, roi: int, overlap: float) -> Column:
    """Tile origins along one axis: even steps of roi (1 - overlap), the last flush with the end."""
    step = max(1, int(roi * (1 - overlap)))
    last = F.greatest(F.ceil((F.col(size) - roi) / step), F.lit(0)).cast("int")
    flush = F.greatest(F.col(size) - roi, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.least(i * step, flush)))


def tile_weights(roi: Sequence[int], spread: float = 0.125) -> np.ndarray:
    """Gaussian importance map, 1 at the tile centre."""
    w = np.ones(1)
    for n in roi:
        c = (n - 1) / 2.0
        w = w[..., None] * np.exp(-0.5 * ((np.arange(n) - c) / (spread * n)) ** 2)
    w = w[0] / w.max()
    return np.maximum(w, w[w > 0].min())


def tile_score(
    norm: DataFrame,
    volumes: DataFrame,
    predict: Callable[[np.ndarray], np.ndarray],
    roi: Sequence[int] = (64, 192, 192),
    overlap: float = 0.25,
    keys: Sequence[str] = KEYS,
    value: str = "norm",
) -> DataFrame:
    """Weighted mean of the user's logits over overlapping tiles, then the logistic function: column p per site.

    One task holds one tile. Tiles without any voxel are scored too.
    """
    keys = list(keys)
    roi = [int(r) for r in roi]
    weights = tile_weights(roi)
    dims = volumes.select(*keys, "nz", "ny", "nx").distinct()
    tiles = dims
    for c, r in zip(ZYX, roi):
        tiles = tiles.withColumn(f"t{c}", F.explode(tile_starts(f"n{c}", r, overlap)))
    # A voxel lies in the tiles whose start is in (v - roi, v]; both sides meet in start cells one roi wide.
    v = norm.select(*keys, *ZYX, F.col(value).alias("value"))
    for c, r in zip(ZYX, roi):
        v = v.withColumn(f"g{c}", F.explode(F.expr(f"array(floor({c} / {r}), floor({c} / {r}) - 1)")))
        tiles = tiles.withColumn(f"g{c}", F.floor(F.col(f"t{c}") / r))
    near = " and ".join(f"({c} is null or ({c} >= t{c} and {c} < t{c} + {r}))" for c, r in zip(ZYX, roi))
    home = ["gz", "gy", "gx"]
    full = tiles.join(v, [*keys, *home], "left").filter(near)
    # Tiles whose candidate voxels all fell outside keep one empty row.
    tag = tiles.withColumns({c: F.lit(None).cast("int") for c in ZYX}).withColumn("value", F.lit(None).cast("double"))
    cols = [*keys, "nz", "ny", "nx", "tz", "ty", "tx", *ZYX, "value"]
    full = full.filter("z is not null").select(*cols).unionByName(tag.select(*cols))
    schema = T.StructType(
        [*field_types(full, keys), *[T.StructField(c, T.IntegerType()) for c in ZYX],
         T.StructField("s", T.DoubleType()), T.StructField("w", T.DoubleType())]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf.iloc[0]
        at = [int(q[f"t{c}"]) for c in ZYX]
        dense = np.zeros(roi)
        own = pdf[pdf["z"].notna()]
        dense[tuple(own[c].to_numpy("int64") - a for c, a in zip(ZYX, at))] = own["value"]
        score = np.asarray(predict(dense), dtype="float64")
        keep = tuple(slice(0, min(r, int(q[f"n{c}"]) - a)) for c, r, a in zip(ZYX, roi, at))
        score, w = score[keep], weights[keep]
        grid = np.indices(score.shape).reshape(3, -1)
        out = {k: [q[k]] * score.size for k in keys}
        out |= {c: (g + a).astype("int32") for c, g, a in zip(ZYX, grid, at)}
        return pd.DataFrame({**out, "s": (score * w).ravel(), "w": w.ravel()})

    parts = full.groupBy(*keys, "nz", "ny", "nx", "tz", "ty", "tx").applyInPandas(run, schema)
    blend = parts.groupBy(*keys, *ZYX).agg((F.sum("s") / F.sum("w")).alias("_l"))
    return blend.select(*keys, *ZYX, (1.0 / (1.0 + F.exp(-F.col("_l")))).alias("p"))
