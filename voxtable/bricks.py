"""Stencil work on bounded bricks.

A voxel is sent to its own brick and to every brick whose halo it lies in, so
each task holds one brick plus a rim, whatever the size of the sample. Masks
travel as words of WORD sites, so a dense one is not multiplied voxel by voxel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .joins import spread_join
from .schemas import KEYS, ZYX, field_types

BRICK = (32, 128, 128)
WORD = 32  # sites of a line that travel as one number


def with_halo(df: DataFrame, brick: Sequence[int], halo: Sequence[int], word: int = 1) -> DataFrame:
    """Rows repeated for each brick (bz, by, bx) they touch; needs nz, ny, nx columns. With ``word``, w holds that many x."""
    for axis, n, b, h in zip(ZYX, ("nz", "ny", "nx"), brick, halo):
        wide = axis == "x" and word > 1
        low = F.col("w") * word if wide else F.col(axis)
        high = F.least(low + (word - 1), F.col(n) - 1) if wide else low
        first = F.greatest(F.floor((low - h) / b), F.lit(0))
        last = F.least(F.floor((high + h) / b), F.floor((F.col(n) - 1) / b))
        first, last = first.cast("int"), last.cast("int")
        target = F.floor(F.col(axis) / b).cast("int") if h == 0 and not wide else F.explode(F.sequence(first, last))
        df = df.withColumn(f"b{axis}", target)
    return df


def as_words(mask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A mask as rows (keys, z, y, w, bits): bit i of ``bits`` stands for x = w * WORD + i. Words pass through."""
    if "bits" in mask.columns:
        return mask
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("x"), F.lit(WORD)).cast("int"))
    return mask.groupBy(*keys, "z", "y", F.floor(F.col("x") / WORD).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits"))


def from_words(words: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The sites behind ``as_words``."""
    sites = words.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).filter(F.getbit("bits", F.col("_i")) == 1)
    return sites.select(*keys, "z", "y", (F.col("w") * WORD + F.col("_i")).cast("int").alias("x"))


def stencil(
    df: DataFrame,
    volumes: DataFrame,
    fn: Callable[[np.ndarray], np.ndarray],
    halo: Sequence[int],
    edge: str = "constant",
    keys: Sequence[str] = KEYS,
    brick: Sequence[int] = BRICK,
) -> DataFrame:
    """Apply ``fn`` to dense bricks of a mask; rows of the True sites it returns.

    ``fn`` gets a boolean array holding the brick with ``halo`` on every side
    (volume edges padded by ``edge``: constant = empty, symmetric = mirrored) and
    returns the boolean brick without the halo.
    """
    keys = list(keys)
    hz = [int(h) for h in halo]
    bs = [int(b) for b in brick]
    dims = volumes.select(*keys, "nz", "ny", "nx").distinct()
    words = spread_join(as_words(df, keys), dims, keys, ["z", "y", "w"])
    src = with_halo(words, bs, hz, WORD)
    cols = ("z", "y", "w")
    schema = T.StructType(
        [*field_types(df, keys), *[T.StructField(c, T.IntegerType()) for c in cols], T.StructField("bits", T.LongType())]
    )
    place = np.arange(WORD, dtype="int64")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        size = [int(first[c]) for c in ("nz", "ny", "nx")]
        start = [int(first[f"b{c}"]) * b for c, b in zip(ZYX, bs)]
        stop = [min(s + b, n) for s, b, n in zip(start, bs, size)]
        lo = [max(0, s - h) for s, h in zip(start, hz)]
        hi = [min(n, e + h) for e, h, n in zip(stop, hz, size)]
        dense = np.zeros([b - a for a, b in zip(lo, hi)], dtype=bool)
        row, bit = np.nonzero((pdf["bits"].to_numpy("int64")[:, None] >> place) & 1)
        x = pdf["w"].to_numpy("int64")[row] * WORD + bit
        near = (x >= lo[2]) & (x < hi[2])
        row, x = row[near], x[near]
        dense[pdf["z"].to_numpy()[row] - lo[0], pdf["y"].to_numpy()[row] - lo[1], x - lo[2]] = True
        pad = [(h - (s - a), h - (b - e)) for h, s, a, b, e in zip(hz, start, lo, hi, stop)]
        if any(p != (0, 0) for p in pad):
            dense = np.pad(dense, pad, mode=edge)
        core = fn(dense)
        # The brick's lines, widened to whole words.
        lead, n_words = start[2] % WORD, -(-(start[2] % WORD + core.shape[2]) // WORD)
        lines = np.zeros((*core.shape[:2], n_words * WORD), dtype=bool)
        lines[:, :, lead : lead + core.shape[2]] = core
        bits = (lines.reshape(*core.shape[:2], n_words, WORD) * (1 << place)).sum(axis=3)
        at = np.nonzero(bits)
        out = {k: np.full(len(at[0]), first[k], dtype=object) for k in keys}
        out |= {c: (i + s).astype("int32") for c, i, s in zip(cols, at, (*start[:2], start[2] // WORD))}
        return pd.DataFrame(out | {"bits": bits[at]})

    return from_words(src.groupBy(*keys, "bz", "by", "bx").applyInPandas(run, schema), keys)
