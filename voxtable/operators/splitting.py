"""Splitting of labels at their narrowest place, by basins of the smoothed distance map.

Voxels climb to their highest neighbour, so an object falls into basins, one per local peak.  What follows works on the
graph of touching basins: how far a peak stands above the way to a higher one, which peaks are seeds, and which seed
each basin joins.  All of it is joins and aggregates, whatever the size of an object.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..bricks import BRICK
from ..joins import spread_join
from ..schemas import KEYS, ZYX, field_types
from ..session import is_empty, materialize
from .components import half_offsets
from .shape import edt
from .stencils import gaussian_weights

# fixed values: first prominence asked, its factor per step and the least one, as shares of the highest peak
FIRST, FACTOR, LEAST = 0.5, 0.75, 0.005


def levels() -> list[float]:
    n = int(np.floor(np.log(LEAST / FIRST) / np.log(FACTOR))) + 1
    return [FIRST * FACTOR**k for k in range(n)]


def heights(labels: DataFrame, asked: DataFrame, keys: Sequence[str] = KEYS, brick: Sequence[int] = BRICK) -> DataFrame:
    """Distance to background in voxels, smoothed by the request's ``sigma``, for every voxel of the asked labels.

    The box of an object with a margin of max(min_distance, int(sigma) + 2) mirrors what the kernel sees beyond it.
    Bricks get a rim as wide as their object's kernel.  Heights are rounded to 1e-9 so that equal places are equal.
    """
    keys = list(keys)
    scope = [*keys, "label"]
    dist = materialize(edt(labels.join(asked, scope, "left_semi"), (1.0, 1.0, 1.0), keys), "split-distance")
    box = dist.groupBy(*scope).agg(*[f(c).alias(f"{n}{c}") for c in ZYX for f, n in ((F.min, "lo"), (F.max, "hi"))])
    margin = F.greatest("min_distance", F.floor("sigma").cast("int") + 2)
    reach = F.when(F.col("sigma") > 0, F.floor(4.0 * F.col("sigma") + 0.5).cast("int")).otherwise(0)
    box = box.join(asked.select(*scope, "sigma", margin.alias("_m"), reach.alias("_r")), scope)
    rows = spread_join(dist, box, scope, ZYX).withColumn("_own", F.lit(True))
    for c in ZYX:
        low, high = F.col(f"lo{c}"), F.col(f"hi{c}")
        copies = F.array(F.col(c), 2 * (low - F.col("_m")) - 1 - F.col(c), 2 * (high + F.col("_m")) + 1 - F.col(c))
        rows = rows.select("*", F.posexplode(copies).alias("_copy", "_at")).filter(
            F.col("_at").between(low - F.col("_r"), high + F.col("_r"))
        )
        rows = rows.withColumn(c, F.col("_at")).withColumn("_own", F.col("_own") & (F.col("_copy") == 0)).drop("_copy", "_at")
    for c, b in zip(ZYX, brick):
        first, last = F.greatest(F.col(c) - F.col("_r"), f"lo{c}"), F.least(F.col(c) + F.col("_r"), f"hi{c}")
        rows = rows.withColumn(f"b{c}", F.explode(F.sequence(F.floor(first / b).cast("int"), F.floor(last / b).cast("int"))))
    schema = T.StructType([*field_types(labels, [*scope, *ZYX]), T.StructField("height", T.DoubleType())])

    def blur(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf.iloc[0]
        r, kernel = int(q["_r"]), gaussian_weights(float(q["sigma"]))
        lo = [max(int(q[f"lo{c}"]), int(q[f"b{c}"]) * b) for c, b in zip(ZYX, brick)]
        hi = [min(int(q[f"hi{c}"]), int(q[f"b{c}"]) * b + b - 1) for c, b in zip(ZYX, brick)]
        dense = np.zeros([b - a + 1 + 2 * r for a, b in zip(lo, hi)])
        dense[tuple(pdf[c].to_numpy() - a + r for c, a in zip(ZYX, lo))] = pdf["dist_um"]
        for axis in range(3):
            n = dense.shape[axis] - 2 * r
            dense = sum(w * dense.take(range(i, i + n), axis) for i, w in enumerate(kernel))
        mine = pdf["_own"].to_numpy().copy()
        for c, a, b in zip(ZYX, lo, hi):
            mine &= pdf[c].between(a, b).to_numpy()
        own = pdf[mine]
        at = tuple(own[c].to_numpy() - a for c, a in zip(ZYX, lo))
        return own.assign(height=np.round(dense[at], 9))[schema.names]

    return rows.groupBy(*scope, *[f"b{c}" for c in ZYX]).applyInPandas(blur, schema)


def _beside(at: str, offset: Column) -> Column:
    return F.struct(*[(F.col(f"{at}.{c}") + offset[c]).alias(c) for c in ZYX])


def _offsets(offsets: Sequence[Sequence[int]]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(int(v)).alias(c) for v, c in zip(o, ZYX)]) for o in offsets]))


def neighbours(sites: DataFrame, value: Sequence[str], scope: Sequence[str], connectivity: int) -> DataFrame:
    """Each pair of touching sites of one object once: at, at_b, ``value`` columns of both, and whether they share a face."""
    scope = list(scope)
    sent = sites.withColumn("_o", _offsets(half_offsets(connectivity)))
    sent = sent.withColumn("at_b", _beside("at", F.col("_o")))
    sent = sent.withColumn("face", (F.abs("_o.z") + F.abs("_o.y") + F.abs("_o.x")) == 1).drop("_o")
    other = sites.select(*scope, F.col("at").alias("at_b"), *[F.col(c).alias(f"{c}_b") for c in value])
    return sent.join(other, [*scope, "at_b"])


def roots(forest: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, at, root) of a forest given as at -> to, roots pointing at themselves.

    Pointers double per round, so rounds grow with the logarithm of the longest way up.  A row that has met a row with
    a known root takes it over and rests.
    """
    scope = list(scope)
    cur = materialize(forest.select(*scope, "at", "to", (F.col("at") == F.col("to")).alias("known")), "pointers")
    while not is_empty(cur.filter("not known")):
        ahead = cur.select(*scope, F.col("at").alias("to"), F.col("to").alias("_to"), F.col("known").alias("_known"))
        moved = cur.filter("not known").join(ahead, [*scope, "to"])
        moved = moved.select(*scope, "at", F.col("_to").alias("to"), F.col("_known").alias("known"))
        cur = materialize(moved.unionByName(cur.filter("known")), "pointers")
    return cur.select(*scope, "at", F.col("to").alias("root"))


def basins(height: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(scope, at, height, basin): the peak each voxel reaches over faces, always to the highest neighbour.

    Of equal neighbours the one with the greatest position counts as higher.
    """
    scope = [*keys, "label"]
    own = height.select(*scope, F.struct(*ZYX).alias("at"), "height")
    faces = [tuple(s * v for v in o) for o in half_offsets(6) for s in (1, -1)]
    sent = own.withColumn("_o", _offsets(faces)).select(
        *scope, _beside("at", F.col("_o")).alias("at"), F.struct("height", "at").alias("_from"), F.lit(None).cast("double").alias("own")
    )
    seen = sent.unionByName(own.select(*scope, "at", F.struct("height", "at").alias("_from"), F.col("height").alias("own")))
    up = seen.groupBy(*scope, "at").agg(F.max("_from").alias("_up"), F.max("own").alias("height")).filter("height is not null")
    up = materialize(up.select(*scope, "at", "height", F.col("_up.at").alias("to")), "ascent")
    return up.select(*scope, "at", "height").join(roots(up, scope), [*scope, "at"]).withColumnRenamed("root", "basin")


def absorb(nodes: DataFrame, edges: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Basins grow together over their highest saddles.

    ``nodes``: at, rank, stays; ``edges``: a, b, saddle.  Per round every node that may move joins the neighbour behind
    its highest saddle if that one has the higher rank; the saddle is then the best way from the node to anything
    higher.  Returns (moves: at, to, saddle) and (homes: at, root).
    """
    scope = list(scope)
    homes = nodes.select(*scope, "at", F.col("at").alias("root"))  # one lazy join per round
    all_moves = None
    while True:
        both = edges.select(*scope, F.col("a").alias("at"), F.col("b").alias("to"), "saddle").unionByName(
            edges.select(*scope, F.col("b").alias("at"), F.col("a").alias("to"), "saddle")
        )
        far = nodes.select(*scope, F.col("at").alias("to"), F.col("rank").alias("_rank"))
        best = both.join(far, [*scope, "to"]).groupBy(*scope, "at").agg(F.max(F.struct("saddle", "_rank", "to")).alias("_b"))
        moves = best.join(nodes.filter("not stays"), [*scope, "at"]).filter("_b._rank > rank")
        moves = materialize(moves.select(*scope, "at", "_b.to", "_b.saddle"), "moves")
        all_moves = moves if all_moves is None else all_moves.unionByName(moves)
        if is_empty(moves):
            return all_moves, homes
        forest = nodes.join(moves, [*scope, "at"], "left").select(*scope, "at", F.coalesce("to", "at").alias("to"))
        top = roots(forest, scope)
        for end in ("a", "b"):
            edges = edges.join(top.select(*scope, F.col("at").alias(end), F.col("root").alias("_r")), [*scope, end])
            edges = edges.drop(end).withColumnRenamed("_r", end)
        edges = edges.filter("a <> b").groupBy(*scope, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = materialize(edges.agg(F.max("saddle").alias("saddle")), "saddles")
        nodes = materialize(nodes.join(moves, [*scope, "at"], "left_anti"), "nodes")
        up = top.select(*scope, F.col("at").alias("root"), F.col("root").alias("_r"))
        homes = homes.join(up, [*scope, "root"]).select(*scope, "at", F.col("_r").alias("root"))


def prominences(peaks: DataFrame, saddles: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, at, height, prominence): how far a peak stands above the best way (over corners too) to a higher one.

    Of equal peaks the one with the greatest position counts as higher.  A piece's highest peak stands above background.
    """
    nodes = peaks.select(*scope, "at", F.struct("height", "at").alias("rank"), F.lit(False).alias("stays"))
    moves, _ = absorb(nodes, saddles, scope)
    low = F.coalesce("saddle", F.lit(0.0))
    return peaks.join(moves.drop("to"), [*scope, "at"], "left").select(*scope, "at", "height", (F.col("height") - low).alias("prominence"))


def choose_seeds(prominent: DataFrame, asked: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Seeds (at, part from 1) and, per request, its status.

    The highest level in ``levels`` that leaves ``n_splits`` peaks decides which peaks count.  The highest of them is
    part 1, then the next that keeps ``min_distance`` from all before it, and so on.
    """
    scope = list(scope)
    shares = levels()
    tops = prominent.groupBy(*scope).agg(F.max("height").alias("_top"))
    wide = prominent.join(tops, scope)
    counts = wide.groupBy(*scope, "_top").agg(
        *[F.sum((F.col("prominence") >= F.col("_top") * s).cast("int")).alias(f"_n{i}") for i, s in enumerate(shares)]
    )
    share = F.coalesce(*[F.when(F.col(f"_n{i}") >= F.col("n_splits"), F.lit(s)) for i, s in enumerate(shares)])
    plan = counts.join(asked, scope).select(
        *scope, "n_splits", "min_distance", (F.col("_top") * share).alias("_level"), F.col(f"_n{len(shares) - 1}").alias("_peaks")
    )
    plan = materialize(plan, "split-plan")
    left = prominent.join(plan.filter("_level is not null"), scope).filter("prominence >= _level")
    left = materialize(left.select(*scope, "at", "height", "n_splits", "min_distance"), "split-peaks")
    most = plan.agg(F.max("n_splits")).first()[0] or 0
    seeds = None
    for part in range(1, most + 1):
        # Ties: the first position, as peaks are listed by descending height.
        order = F.struct("height", *[-F.col(f"at.{c}") for c in ZYX])
        top = left.filter(F.col("n_splits") >= part).groupBy(*scope).agg(F.max_by("at", order).alias("at"))
        top = materialize(top.withColumn("part", F.lit(part)), "seed")
        seeds = top if seeds is None else seeds.unionByName(top)
        apart = sum((F.col(f"at.{c}") - F.col(f"_s.{c}")) ** 2 for c in ZYX)
        near = left.join(top.select(*scope, F.col("at").alias("_s")), scope)
        near = near.filter((F.col("at") != F.col("_s")) & (apart >= F.col("min_distance") ** 2))
        left = materialize(near.drop("_s"), "split-peaks")
    if seeds is None:
        seeds = prominent.select(*scope, "at", F.lit(0).alias("part")).limit(0)
    got = plan.join(seeds.groupBy(*scope).agg(F.count("*").alias("_seeds")), scope, "left")
    few = F.concat(F.lit("only "), F.col("_peaks").cast("string"), F.lit(" prominent peaks"))
    close = F.concat(F.lit("only "), F.col("_seeds").cast("string"), F.lit(" peaks at the asked distance"))
    status = F.when(F.col("_level").isNull(), few).when(F.col("_seeds") < F.col("n_splits"), close).otherwise(F.lit("ok"))
    status = materialize(got.select(*scope, "n_splits", status.alias("status")), "split-status")
    good = status.filter("status = 'ok'")
    return seeds.join(good, scope, "left_semi"), status


def split_parts(labels: DataFrame, asked: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(scope, z, y, x, part) of the labels that could be split, before the cut, and the status of each request."""
    scope = [*keys, "label"]
    sites = materialize(basins(heights(labels, asked, keys), keys), "basins")
    peaks = sites.filter("at = basin").select(*scope, "at", "height")
    low = F.least("height", "height_b")
    edges = neighbours(sites, ["height", "basin"], scope, 26).filter("basin <> basin_b")
    edges = edges.groupBy(*scope, F.least("basin", "basin_b").alias("a"), F.greatest("basin", "basin_b").alias("b"))
    edges = materialize(edges.agg(F.max(low).alias("saddle"), F.max(F.when(F.col("face"), low)).alias("_face")), "saddles")
    prominent = materialize(prominences(peaks, edges.drop("_face"), scope), "prominences")
    seeds, status = choose_seeds(prominent, asked, scope)
    seeds = materialize(seeds, "seeds")
    nodes = peaks.join(seeds, [*scope, "at"], "left").join(seeds.select(*scope).distinct(), scope, "left_semi")
    nodes = nodes.select(
        *scope, "at", F.struct(F.col("part").isNotNull(), F.col("height"), F.col("at")).alias("rank"), F.col("part").isNotNull().alias("stays")
    )
    ways = edges.join(seeds.select(*scope).distinct(), scope, "left_semi").filter("_face is not null")
    _, homes = absorb(materialize(nodes, "nodes"), ways.select(*scope, "a", "b", F.col("_face").alias("saddle")), scope)
    owner = homes.join(seeds.withColumnRenamed("at", "root"), [*scope, "root"]).select(*scope, F.col("at").alias("basin"), "part")
    parts = sites.join(owner, [*scope, "basin"]).select(*scope, *[F.col(f"at.{c}").alias(c) for c in ZYX], "part")
    return parts, status


def split_labels(labels: DataFrame, requests: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Split requested labels at their narrowest place. Returns (labels, status).

    ``requests``: label, n_splits, sigma, min_distance; of several for one label the least is taken. Part 1 keeps the
    id; the other parts are numbered after the sample's largest id, request by request in label order. Voxels on both
    sides of a cut, and pieces that no seed reaches over faces, become background. Requests that cannot be met leave
    the label as it was and say why in ``status``.
    """
    keys = list(keys)
    scope = [*keys, "label"]
    asked = requests.groupBy(*scope).agg(F.min(F.struct("n_splits", "sigma", "min_distance")).alias("_q")).select(*scope, "_q.*")
    asked = materialize(asked, "split-requests")
    parts, status = split_parts(labels, asked, keys)
    parts = materialize(parts, "split-parts")
    sites = parts.select(*scope, F.struct(*ZYX).alias("at"), "part")
    touch = neighbours(sites, ["part"], scope, 6).filter("part <> part_b")
    cut = touch.select(*scope, "at").unionByName(touch.select(*scope, F.col("at_b").alias("at"))).distinct()
    kept = parts.join(cut.select(*scope, "at.*"), [*scope, *ZYX], "left_anti")
    before = W.partitionBy(*keys).orderBy("label").rowsBetween(W.unboundedPreceding, -1)
    good = status.filter("status = 'ok'")
    shift = good.withColumn("_shift", F.coalesce(F.sum(F.col("n_splits") - 1).over(before), F.lit(0)))
    top = labels.groupBy(*keys).agg(F.max("label").alias("_top"))
    ids = shift.join(top, keys).select(*scope, (F.col("_top") + F.col("_shift")).alias("_base"))
    named = F.when(F.col("part") == 1, F.col("label")).otherwise(F.col("_base") + F.col("part") - 1)
    new = kept.join(ids, scope).select(*keys, *ZYX, named.cast("int").alias("label"))
    rest = labels.join(good, scope, "left_anti").select(*keys, *ZYX, "label")
    said = asked.select(*scope).join(status.select(*scope, "status"), scope, "left")
    return rest.unionByName(new), said.select(*scope, F.coalesce("status", F.lit("label not found")).alias("status"))
