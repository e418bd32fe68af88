"""Queries: masks, background, normalisation and stencils."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import masks as M, stencils as S
from ..plans import jobs as J
from ..schemas import ZYX
from .base import (
    BRAIN, PROBS, VOL, VOX, blocks, blocks_sql, brain, cc_sql, occ_sql, occupied, probs, query, rounded, truth, labels_sql, vol, vox, with_,
)


def points(df):
    return df.select("fish_id", *ZYX)


INSIDE = "inside AS (SELECT v.* FROM vox v JOIN brain USING (fish_id, z, y, x))"
MODE = """hist0 AS (SELECT fish_id, value, count(*) AS n FROM inside GROUP BY ALL
  UNION ALL SELECT b.fish_id, 0, b.n - coalesce(i.n, 0) FROM (SELECT fish_id, count(*) AS n FROM brain GROUP BY ALL) b
  LEFT JOIN (SELECT fish_id, count(*) AS n FROM inside GROUP BY ALL) i USING (fish_id)),
hist AS (SELECT * FROM hist0 WHERE n > 0),
ends AS (SELECT fish_id, min(value) AS lo, max(value) AS hi FROM hist GROUP BY ALL),
bins AS (SELECT fish_id, lo, hi, least(floor((value - lo) / (hi - lo) * 1000), 999) AS bin, sum(n) AS n FROM hist JOIN ends USING (fish_id) GROUP BY ALL),
mode AS (SELECT fish_id, lo + bin * ((hi - lo) / 1000) + ((hi - lo) / 1000) / 2 AS mode FROM
  (SELECT *, row_number() OVER (PARTITION BY fish_id ORDER BY n DESC, bin) AS r FROM bins) WHERE r = 1),
rng AS (SELECT fish_id, max(value) - 0 AS data_range FROM vox GROUP BY ALL),
thr AS (SELECT fish_id, mode, data_range, mode + data_range * (CAST(2.5 AS DOUBLE) / 100.0) AS thresh FROM mode JOIN rng USING (fish_id))"""
BASE = (VOX, VOL, BRAIN, INSIDE, MODE)


@query("background_mode", with_(*BASE, body="SELECT fish_id, round(mode, 6) AS mode FROM mode"))
def background_mode(spark, sf):
    """Tallest of 1,000 bins over the full box mask, absent sites counted as 0."""
    return rounded(M.background_mode(vox(spark, sf), brain(spark, sf)))


@query("background_mode_bright", with_(VOX, VOL, "brain AS (SELECT fish_id, z, y, x FROM vox WHERE x BETWEEN 4 AND 19)", INSIDE, MODE, body="SELECT fish_id, round(mode, 6) AS mode FROM mode"))
def background_mode_bright(spark, sf):
    """The same over occupied sites only."""
    mask = points(vox(spark, sf).filter("x between 4 and 19"))
    return rounded(M.background_mode(vox(spark, sf), mask))


@query("background_threshold", with_(*BASE, body="SELECT fish_id, round(mode, 6) AS mode, round(data_range, 6) AS data_range, round(thresh, 6) AS thresh FROM thr"))
def background_threshold(spark, sf):
    return rounded(M.background_threshold(vox(spark, sf), brain(spark, sf), vol(spark, sf), 2.5))


@query("remove_outside", with_(*BASE, body="""
SELECT v.fish_id, v.z, v.y, v.x, round(v.value, 6) AS value FROM vox v JOIN thr USING (fish_id) LEFT JOIN brain b ON b.fish_id = v.fish_id AND b.z = v.z AND b.y = v.y AND b.x = v.x
WHERE b.fish_id IS NOT NULL OR v.value > thresh"""))
def remove_outside(spark, sf):
    return rounded(M.remove_outside(vox(spark, sf), brain(spark, sf), vol(spark, sf), 2.5).select("fish_id", *ZYX, "value"))


@query("remove_global", with_(*BASE, body="""
SELECT v.fish_id, v.z, v.y, v.x, round(v.value, 6) AS value FROM vox v JOIN thr USING (fish_id) WHERE v.value > thresh"""))
def remove_global(spark, sf):
    return rounded(M.remove_global(vox(spark, sf), brain(spark, sf), vol(spark, sf), 2.5).select("fish_id", *ZYX, "value"))


@query("fill_outside_random", with_(VOX, VOL, BRAIN, body="""
SELECT v.fish_id, nz * ny * nx - m.n AS n_noise, i.n AS n_inside, true AS in_range FROM vol v JOIN (SELECT fish_id, count(*) AS n FROM brain GROUP BY ALL) m USING (fish_id)
JOIN (SELECT fish_id, count(*) AS n FROM vox JOIN brain USING (fish_id, z, y, x) GROUP BY ALL) i USING (fish_id)"""))
def fill_outside_random(spark, sf):
    """Counts of noise and kept sites, and whether every draw lies in mode +- 0.1 % of the range."""
    v, m, d = vox(spark, sf), brain(spark, sf), vol(spark, sf)
    out = M.fill_outside_random(v, m, d, seed=7).join(M.background_threshold(v, m, d, 0.0), "fish_id")
    near = F.abs(F.col("value") - F.col("mode")) <= F.col("data_range") * 0.001 + 1e-9
    return out.groupBy("fish_id").agg(
        F.sum((~F.col("inside")).cast("long")).alias("n_noise"), F.sum(F.col("inside").cast("long")).alias("n_inside"),
        F.min(F.when(~F.col("inside"), near)).alias("in_range"),
    )


@query("apply_mask", with_(VOX, VOL, BRAIN, body="SELECT fish_id, count(*) AS n, round(sum(value), 4) AS total FROM vox JOIN brain USING (fish_id, z, y, x) GROUP BY ALL"))
def apply_mask(spark, sf):
    return M.apply_mask(vox(spark, sf), brain(spark, sf)).groupBy("fish_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("invert_mask", with_(VOX, VOL, BRAIN, body="""
SELECT fish_id, count(*) AS n, round(sum(value), 4) AS total FROM vox v WHERE NOT EXISTS (SELECT 1 FROM brain b WHERE b.fish_id = v.fish_id AND b.z = v.z AND b.y = v.y AND b.x = v.x) GROUP BY ALL"""))
def invert_mask(spark, sf):
    return M.invert_mask(vox(spark, sf), brain(spark, sf)).groupBy("fish_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("skin_mask", with_(VOX, VOL, BRAIN, body="""
SELECT fish_id, nz * ny * nx - n AS n FROM vol JOIN (SELECT fish_id, count(*) AS n FROM brain GROUP BY ALL) USING (fish_id)"""))
def skin_mask(spark, sf):
    return J.skin_mask(brain(spark, sf), vol(spark, sf)).groupBy("fish_id").agg(F.count("*").alias("n"))


@query("binarize", with_(VOX, PROBS, body="SELECT fish_id, z, y, x FROM probs WHERE p > 0.5"))
def binarize(spark, sf):
    return M.binarize(probs(spark, sf), "p > 0.5")


for _name, _sql in (
    ("and", "SELECT fish_id, z, y, x FROM a INTERSECT SELECT fish_id, z, y, x FROM b"),
    ("or", "SELECT fish_id, z, y, x FROM a UNION SELECT fish_id, z, y, x FROM b"),
    ("andnot", "SELECT fish_id, z, y, x FROM a EXCEPT SELECT fish_id, z, y, x FROM b"),
):

    @query(f"mask_{_name}", with_(VOX, VOL, occ_sql("a", 20), "b AS (SELECT * FROM vox WHERE x BETWEEN 4 AND 19 AND z BETWEEN 2 AND 27)", body=_sql))
    def _mask(spark, sf, name=_name):
        b = points(vox(spark, sf).filter("x between 4 and 19 and z between 2 and 27"))
        return getattr(M, f"mask_{name}")(occupied(spark, sf, 20.0), b)


@query("normalize", with_(VOX, VOL, body="""
, full_v AS (SELECT v.fish_id, coalesce(x.value, 0) AS value FROM (SELECT fish_id, a.z, b.y, c.x FROM vol, range(0, 30) a(z), range(0, 100000) b(y), range(0, 24) c(x) WHERE b.y < ny) v
  LEFT JOIN vox x USING (fish_id, z, y, x)),
q AS (SELECT fish_id, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM full_v GROUP BY ALL)
SELECT fish_id, z, y, x, round(least(greatest((value - p01) / greatest(p99 - p01, 1.0), 0.0), 1.0), 6) AS norm FROM vox JOIN q USING (fish_id)""".strip()))
def normalize(spark, sf):
    return rounded(M.normalize(vox(spark, sf), vol(spark, sf)).select("fish_id", *ZYX, "norm"))


SCORES = """
tp AS (SELECT fish_id, count(*) AS tp FROM a JOIN b USING (fish_id, z, y, x) GROUP BY ALL),
pv AS (SELECT fish_id, count(*) AS pred_vox FROM a GROUP BY ALL), gv AS (SELECT fish_id, count(*) AS gt_vox FROM b GROUP BY ALL)"""


@query("mask_scores", with_(VOX, VOL, occ_sql("a", 20), BRAIN, "b AS (SELECT * FROM brain)", SCORES, body="""
SELECT fish_id, round(200.0 * tp / (pred_vox + gt_vox), 6) AS dice, round(100.0 * tp / (pred_vox + gt_vox - tp), 6) AS iou,
  round(100.0 * tp / pred_vox, 6) AS precision, round(100.0 * tp / gt_vox, 6) AS recall, pred_vox, gt_vox FROM pv JOIN gv USING (fish_id) JOIN tp USING (fish_id)"""))
def mask_scores(spark, sf):
    return rounded(M.mask_scores(occupied(spark, sf, 20.0), brain(spark, sf)))


@query("full_volume_dice", with_(VOX, VOL, occ_sql("a", 20), BRAIN, "b AS (SELECT * FROM brain)", SCORES, body="""
SELECT round(avg(2.0 * tp / (pred_vox + gt_vox + 1e-8)), 9) AS mean_dice, count(*) AS n FROM pv JOIN gv USING (fish_id) JOIN tp USING (fish_id)"""))
def full_volume_dice(spark, sf):
    d = M.full_volume_dice(occupied(spark, sf, 20.0), brain(spark, sf))
    return d.agg(F.round(F.avg("dice"), 9).alias("mean_dice"), F.count("*").alias("n"))


def erosion_sql(flat: bool, n: int) -> str:
    size = 2 * n * n + 2 * n + 1 if flat else sum(2 * (n - abs(k)) ** 2 + 2 * (n - abs(k)) + 1 for k in range(-n, n + 1))
    z = "b.z = a.z" if flat else f"b.z BETWEEN a.z - {n} AND a.z + {n}"
    d = "abs(b.y - a.y) + abs(b.x - a.x)" + ("" if flat else " + abs(b.z - a.z)")
    return f"""SELECT a.fish_id, a.z, a.y, a.x FROM m a JOIN m b ON b.fish_id = a.fish_id AND {z} AND b.y BETWEEN a.y - {n} AND a.y + {n}
AND b.x BETWEEN a.x - {n} AND a.x + {n} WHERE {d} <= {n} GROUP BY ALL HAVING count(*) = {size}"""


M_SQL = "m AS (SELECT fish_id, z, y, x FROM brain WHERE NOT (y % 7 = 3 AND x % 5 = 2))"


def pitted(spark, sf):
    """The box mask with regular one-site holes."""
    return brain(spark, sf).filter("not (y % 7 = 3 and x % 5 = 2)")


for _flat, _n in ((True, 1), (True, 2), (False, 1), (False, 2)):

    @query(f"erode{'2d' if _flat else '3d'}_{_n}", with_(VOX, VOL, BRAIN, M_SQL, body=erosion_sql(_flat, _n)))
    def _erode(spark, sf, flat=_flat, n=_n):
        fn = S.erode2d if flat else S.erode3d
        return fn(pitted(spark, sf), vol(spark, sf), n)


@query("remove_global_eroded", with_(VOX, VOL, BRAIN, M_SQL, body=erosion_sql(True, 1)))
def remove_global_eroded(spark, sf):
    """A bright pitted box: every site passes the threshold, then one step of per-slice erosion."""
    v = pitted(spark, sf).withColumn("value", F.lit(100.0) + F.col("x") % 3)
    return points(M.remove_global(v, brain(spark, sf), vol(spark, sf), -50.0, 1))


@query("erode3d_small_bricks", with_(VOX, VOL, BRAIN, M_SQL, body=erosion_sql(False, 2)))
def erode3d_small_bricks(spark, sf):
    """The same erosion cut into 8-site bricks with halos."""
    return S.erode3d(pitted(spark, sf), vol(spark, sf), 2, brick=(8, 8, 8))


@query("z_median", with_(VOX, VOL, occ_sql("o", 0), body="""
, t AS (SELECT fish_id, least(greatest(z + d, 0), 29) AS z, y, x FROM o, (VALUES (-1), (0), (1)) v(d))
SELECT fish_id, CAST(z AS INT) AS z, y, x FROM t GROUP BY ALL HAVING count(*) >= 2""".strip()))
def z_median(spark, sf):
    return S.z_median3(occupied(spark, sf, 0.0), vol(spark, sf))


def smooth_sql(src: str, out: str, sxy: float, sz: float) -> str:
    """Three separable passes with mirrored edges, then > 0.5."""

    def pass_(prev, name, axis, sigma, size):
        r = int(4 * sigma + 0.5)
        w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
        t = sum(w)
        vals = ", ".join(f"({i - r}, CAST({v / t!r} AS DOUBLE))" for i, v in enumerate(w))
        rest = [c for c in "zyx" if c != axis]
        # An output site reads mirrored inputs, so an input feeds itself and its mirror images.
        return f"""{name} AS (SELECT fish_id, {axis}, {rest[0]}, {rest[1]}, sum(v) AS v FROM (
  SELECT p.fish_id, p.{rest[0]}, p.{rest[1]}, m.{axis} + d AS {axis}, p.v * w AS v, s.n AS n FROM {prev} p JOIN (SELECT fish_id, {size} AS n FROM vol) s USING (fish_id),
    LATERAL (SELECT unnest([p.{axis}, -1 - p.{axis}, 2 * s.n - 1 - p.{axis}]) AS {axis}) m, (VALUES {vals}) k(d, w)) WHERE {axis} >= 0 AND {axis} < n GROUP BY ALL)"""

    return ",\n".join(
        [
            f"{out}_0 AS (SELECT fish_id, z, y, x, CAST(1 AS DOUBLE) AS v FROM {src})",
            pass_(f"{out}_0", f"{out}_1", "z", sz, "nz"),
            pass_(f"{out}_1", f"{out}_2", "y", sxy, "ny"),
            pass_(f"{out}_2", f"{out}_3", "x", sxy, "nx"),
            f"{out} AS (SELECT fish_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM {out}_3 WHERE v > 0.5)",
        ]
    )


@query("smooth_mask", with_(VOX, VOL, occ_sql("o", 0), smooth_sql("o", "s", 0.7, 0.5), body="SELECT * FROM s"))
def smooth_mask(spark, sf):
    return S.smooth_mask(occupied(spark, sf, 0.0), vol(spark, sf), 0.7, 0.5)


@query("smooth_mask_small_bricks", with_(VOX, VOL, BRAIN, M_SQL, smooth_sql("m", "s", 1.0, 0.5), body="SELECT * FROM s"))
def smooth_mask_small_bricks(spark, sf):
    return S.smooth_mask(pitted(spark, sf), vol(spark, sf), 1.0, 0.5, brick=(8, 16, 16))


def holes_sql(src: str, out: str) -> str:
    """Enclosed 4-connected background pieces per slice: fish_id, z, y, x, component."""
    return f"""{out}_b AS (SELECT fish_id, z, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM {src} GROUP BY ALL),
{out}_l AS (SELECT fish_id, z, CAST(b.y AS INT) + 1 AS y, CAST(c.x AS INT) + 1 AS x, y0 + 1 AS y0, x0 + 1 AS x0 FROM {out}_b, range(-1, 2000) b(y), range(-1, 100) c(x)
  WHERE b.y BETWEEN y0 AND y1 AND c.x BETWEEN x0 AND x1),
{out}_f AS (SELECT * FROM {out}_l l WHERE NOT EXISTS (SELECT 1 FROM {src} s WHERE s.fish_id = l.fish_id AND s.z = l.z AND s.y + 1 = l.y AND s.x + 1 = l.x)),
{out}_w(fish_id, z, y, x) AS (SELECT fish_id, z, y, x FROM {out}_f WHERE y = y0 AND x = x0 UNION
  SELECT f.fish_id, f.z, f.y, f.x FROM {out}_w w, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx), {out}_f f WHERE f.fish_id = w.fish_id AND f.z = w.z AND f.y = w.y + d.dy AND f.x = w.x + d.dx),
{out}_i AS (SELECT fish_id, z, y, x FROM {out}_f EXCEPT SELECT fish_id, z, y, x FROM {out}_w),
{cc_sql(out + "_i", out + "_c", 4, "fish_id, z")},
{out} AS (SELECT fish_id, z, y - 1 AS y, x - 1 AS x, component, count(*) OVER (PARTITION BY fish_id, z, component) AS hole_size FROM {out}_c)"""


@query("fill_holes2d", with_(VOX, VOL, occ_sql("o", 0), holes_sql("o", "h"), body="SELECT fish_id, z, y, x FROM o UNION ALL SELECT fish_id, z, y, x FROM h"))
def fill_holes2d(spark, sf):
    return S.fill_holes2d(occupied(spark, sf, 0.0))


@query("fill_holes2d_limited", with_(VOX, VOL, occ_sql("o", 0), holes_sql("o", "h"), body="SELECT fish_id, z, y, x FROM o UNION ALL SELECT fish_id, z, y, x FROM h WHERE hole_size < 3"))
def fill_holes2d_limited(spark, sf):
    return S.fill_holes2d(occupied(spark, sf, 0.0), 3)


@query("fill_holes3d", with_(VOX, VOL, BRAIN, "m AS (SELECT fish_id, z, y, x FROM brain WHERE NOT (y % 7 = 3 AND x % 5 = 2 AND z % 3 = 0))", body="SELECT fish_id, z, y, x FROM m UNION SELECT fish_id, z, y, x FROM brain b WHERE z > 2 AND z < 27 AND x > 4 AND x < 19 AND y > 0 AND y < (SELECT ny - 1 FROM vol v WHERE v.fish_id = b.fish_id)"))
def fill_holes3d(spark, sf):
    """A box with single-site pockets; pockets on the box faces stay open."""
    m = brain(spark, sf).filter("not (y % 7 = 3 and x % 5 = 2 and z % 3 = 0)")
    return S.fill_holes3d(m)


@query("contact", with_(VOX, blocks_sql(), body="""
, p AS (SELECT DISTINCT a.fish_id, a.label AS source, b.label AS target, b.z, b.y, b.x FROM blk a JOIN blk b ON b.fish_id = a.fish_id AND b.label <> a.label
  AND abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x) = 1)
SELECT fish_id, source, target, count(*) AS contact FROM p GROUP BY ALL""".strip()))
def contact(spark, sf):
    return S.contact(blocks(spark, sf))


@query("surface", with_(VOX, blocks_sql(), body="""
SELECT a.fish_id, a.z, a.y, a.x, a.label FROM blk a LEFT JOIN blk b ON b.fish_id = a.fish_id AND b.label = a.label AND abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x) = 1
GROUP BY ALL HAVING count(b.label) < 6"""))
def surface(spark, sf):
    return S.surface(blocks(spark, sf))


@query("interface_cut", with_(VOX, blocks_sql(), body="""
SELECT a.fish_id, a.z, a.y, a.x, a.label FROM blk a WHERE NOT EXISTS (SELECT 1 FROM blk b WHERE b.fish_id = a.fish_id AND b.label <> a.label AND abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x) = 1)"""))
def interface_cut(spark, sf):
    return S.interface_cut(blocks(spark, sf)).select("fish_id", *ZYX, "label")


@query("thin_weights", with_(VOX, VOL, BRAIN, M_SQL, body="""
, w AS (SELECT a.fish_id, a.z, a.y, a.x, count(*) AS n,
  (least(a.y + 2, (SELECT ny - 1 FROM vol v WHERE v.fish_id = a.fish_id)) - greatest(a.y - 2, 0) + 1) * (least(a.x + 2, 23) - greatest(a.x - 2, 0) + 1) AS need
  FROM m a JOIN m b ON b.fish_id = a.fish_id AND b.z = a.z AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY ALL)
SELECT fish_id, z, y, x, CASE WHEN n = need THEN CAST(1 AS DOUBLE) ELSE CAST(3.5 AS DOUBLE) END AS weight FROM w""".strip()))
def thin_weights(spark, sf):
    return S.thin_weights(pitted(spark, sf), vol(spark, sf), 2, 2.5)


@query("postprocess", with_(VOX, PROBS, "t AS (SELECT fish_id, z, y, x FROM probs WHERE p > 0.1)", cc_sql("t", "c", 6), body="""
, s AS (SELECT fish_id, component, count(*) AS n FROM c GROUP BY ALL),
b AS (SELECT fish_id, component FROM (SELECT *, row_number() OVER (PARTITION BY fish_id ORDER BY n DESC, component) AS r FROM s) WHERE r = 1),
m AS (SELECT fish_id, z, y, x FROM c JOIN b USING (fish_id, component)),
bx AS (SELECT fish_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM m GROUP BY ALL),
f AS (SELECT fish_id, CAST(a.z AS INT) AS z, CAST(b.y AS INT) AS y, CAST(c.x AS INT) AS x, z0, y0, x0 FROM bx, range(-1, 40) a(z), range(-1, 2000) b(y), range(-1, 40) c(x)
  WHERE a.z BETWEEN z0 - 1 AND z1 + 1 AND b.y BETWEEN y0 - 1 AND y1 + 1 AND c.x BETWEEN x0 - 1 AND x1 + 1
  AND NOT EXISTS (SELECT 1 FROM m WHERE m.fish_id = bx.fish_id AND m.z = a.z AND m.y = b.y AND m.x = c.x)),
w(fish_id, z, y, x) AS (SELECT fish_id, z, y, x FROM f WHERE z = z0 - 1 AND y = y0 - 1 AND x = x0 - 1 UNION
  SELECT f.fish_id, f.z, f.y, f.x FROM w, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) d(dz, dy, dx), f
  WHERE f.fish_id = w.fish_id AND f.z = w.z + d.dz AND f.y = w.y + d.dy AND f.x = w.x + d.dx)
SELECT fish_id, z, y, x FROM m UNION ALL (SELECT fish_id, z, y, x FROM f EXCEPT SELECT fish_id, z, y, x FROM w)""".strip()))
def postprocess(spark, sf):
    return M.postprocess(probs(spark, sf), 0.1)


@query("create_labels", with_(VOX, VOL, occ_sql("o", 0), smooth_sql("o", "s", 0.7, 0.5), holes_sql("s", "h"), "f AS (SELECT fish_id, z, y, x FROM s UNION ALL SELECT fish_id, z, y, x FROM h)",
  cc_sql("f", "c"), body="""
, k AS (SELECT fish_id, component, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 5)
SELECT fish_id, CAST(row_number() OVER (PARTITION BY fish_id ORDER BY n DESC, component DESC) AS INT) AS label, n FROM k""".strip()))
def create_labels(spark, sf):
    """Binarise -> smooth -> fill -> components -> floor -> number by volume."""
    from ..operators.labels import create_labels as make

    return make(vox(spark, sf), vol(spark, sf), 0.7, 0.5, min_volume=8).groupBy("fish_id", "label").agg(F.count("*").alias("n"))


@query("min_hole_size", with_(VOX, VOL, labels_sql("g", 0), "gl AS (SELECT fish_id || '/' || label AS fish_id, z, y, x FROM g)", holes_sql("gl", "h"), body="""
SELECT f.fish_id, CAST(coalesce(min(h.hole_size), 20) AS INT) AS min_hole_size FROM (SELECT DISTINCT fish_id FROM vox) f
LEFT JOIN (SELECT split_part(fish_id, '/', 1) AS fish_id, hole_size FROM h WHERE hole_size >= 2) h USING (fish_id) GROUP BY ALL"""))
def min_hole_size(spark, sf):
    return J.smallest_holes(truth(spark, sf), trust=2).withColumn("min_hole_size", F.col("min_hole_size").cast("int"))


@query("removal_stats", with_(*BASE, body="""
, k AS (SELECT fish_id, count(*) AS n_before, count(*) FILTER (value > thresh) AS n_after FROM vox JOIN thr USING (fish_id) GROUP BY ALL)
SELECT fish_id, n_before, n_after, n_before - n_after AS n_removed, round((n_before - n_after) * 100.0::DOUBLE / (nz * ny * nx), 6) AS pct_of_stack, round((n_before - n_after) * 100.0::DOUBLE / n_before, 6) AS pct_of_occupied
FROM k JOIN vol USING (fish_id)""".strip()))
def removal_stats(spark, sf):
    v, d = vox(spark, sf), vol(spark, sf)
    return rounded(M.removal_stats(v, M.remove_global(v, brain(spark, sf), d, 2.5), d))
