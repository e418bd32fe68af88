"""Queries: mesh area, hull, distance, skeletons, splitting, outlines and crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crops as C, outlines as O, shape as SH, splitting as SP
from ..plans import jobs as J
from ..schemas import ZYX
from ..session import materialize
from .base import SCALE, VOL, VOX, blocks, blocks_sql, query, rounded, table, truth, vol, vox, with_

B = (VOX, VOL, blocks_sql())


def areas_sql() -> str:
    return "tab(code, area) AS (VALUES " + ", ".join(f"({i}, CAST({a!r} AS DOUBLE))" for i, a in enumerate(SH.cell_areas(*SCALE))) + ")"


@query("surface_area", with_(*B, areas_sql(), body="""
, c AS (SELECT fish_id, label, z - dz AS z, y - dy AS y, x - dx AS x, bit_or(1 << (4 * dz + 2 * dy + dx)) AS code FROM blk, (VALUES (0), (1)) a(dz), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) d(dx) GROUP BY ALL)
SELECT fish_id, label, round(sum(area), 6) AS surface_area_um2 FROM c JOIN tab USING (code) GROUP BY ALL""".strip()))
def surface_area(spark, sf):
    return rounded(SH.surface_area(blocks(spark, sf), SCALE))


@query("solidity")
def solidity(spark, sf):
    return rounded(SH.solidity(blocks(spark, sf)))


@query("flag_porous")
def flag_porous(spark, sf):
    return SH.flag_porous(SH.solidity(blocks(spark, sf)), 0.5).groupBy("fish_id").agg(F.count("*").alias("n_porous"))


@query("edt", with_(*B, body=f"""
, bx AS (SELECT fish_id, label, min(z) - 1 AS z0, max(z) + 1 AS z1, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM blk GROUP BY ALL),
bg AS (SELECT fish_id, label, a.z, b.y, c.x FROM bx, range(-1, 31) a(z), range(-1, 2000) b(y), range(-1, 25) c(x) WHERE a.z BETWEEN z0 AND z1 AND b.y BETWEEN y0 AND y1 AND c.x BETWEEN x0 AND x1
  AND NOT EXISTS (SELECT 1 FROM blk k WHERE k.fish_id = bx.fish_id AND k.label = bx.label AND k.z = a.z AND k.y = b.y AND k.x = c.x))
SELECT k.fish_id, k.label, k.z, k.y, k.x, round(min(sqrt(((k.z - g.z) * {SCALE[0]}) ** 2 + ((k.y - g.y) * {SCALE[1]}) ** 2 + ((k.x - g.x) * {SCALE[2]}) ** 2)), 6) AS dist_um
FROM blk k JOIN bg g USING (fish_id, label) GROUP BY ALL""".strip()))
def edt(spark, sf):
    return rounded(SH.edt(blocks(spark, sf), SCALE)).select("fish_id", "label", *ZYX, "dist_um")


@query("skeleton_branches")
def skeleton_branches(spark, sf):
    b = SH.skeleton_branches(truth(spark, sf), SCALE)
    return b.groupBy("fish_id", "branch_type").agg(F.count("*").alias("n"), F.round(F.sum("path_um"), 4).alias("path_um"))


@query("branch_stats")
def branch_stats(spark, sf):
    g = truth(spark, sf)
    return rounded(SH.branch_stats(SH.skeleton_branches(g, SCALE), g))


@query("branch_diameters")
def branch_diameters(spark, sf):
    return rounded(SH.branch_diameters(truth(spark, sf), SCALE, 20))


@query("recommend_branch_radius", """
WITH d AS (SELECT l_returnflag AS fish_id, l_quantity * 0.05::DOUBLE AS diam_um FROM lineitem), q AS (SELECT fish_id, quantile_cont(diam_um, 0.25) AS p25 FROM d GROUP BY ALL)
SELECT fish_id, round(avg(diam_um) / 2, 6) AS tip_radius_um, CAST(greatest(1, round_even(avg(diam_um) / 2 / 0.17366, 0)) AS INT) AS branch_radius_px FROM d JOIN q USING (fish_id) WHERE diam_um <= p25 GROUP BY ALL""")
def recommend_branch_radius(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("fish_id"), (F.col("l_quantity") * 0.05).alias("diam_um"))
    return rounded(SH.recommend_branch_radius(d, 0.17366))


@query("complex_cells")
def complex_cells(spark, sf):
    return rounded(SH.complex_cells(truth(spark, sf), SCALE, 5))


@query("resort_complexity")
def resort_complexity(spark, sf):
    from ..operators.labels import resort_labels

    out = resort_labels(blocks(spark, sf), "complexity")
    return out.groupBy("fish_id").agg(F.countDistinct("label").alias("n_labels"), F.max("label").alias("top"), F.count("*").alias("n_voxels"))


@query("split_labels")
def split_labels(spark, sf):
    """The ten largest cells of each sample are asked to split in two."""
    from ..operators.labels import relabel_by_volume

    g = materialize(relabel_by_volume(truth(spark, sf)))
    req = g.filter("label <= 10").select("fish_id", "label").distinct().select(
        "fish_id", "label", F.lit(2).alias("n_splits"), F.lit(0.5).alias("sigma"), F.lit(2).alias("min_distance")
    )
    out, status = SP.split_labels(g, req)
    n = out.groupBy("fish_id").agg(F.countDistinct("label").alias("n_labels"), F.count("*").alias("n_voxels"))
    s = status.groupBy("fish_id").agg(F.sum((F.col("status") == "ok").cast("int")).alias("n_split"))
    return n.join(s, "fish_id")


# --- outlines: one octagon per user and active day ---------------------------------

ANGLES = [k * 3.141592653589793 / 4 for k in range(8)]


def outlines(spark, sf):
    e = table(spark, sf, "events")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    p = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fish_id"), day.alias("z")).agg(F.count("*").alias("n"))
    r = F.least(F.col("n"), F.lit(6)) + 3.137
    pts = F.array(*[F.struct((F.sin(F.lit(a)) * r + 12.0531).alias("y"), (F.cos(F.lit(a)) * r + 11.9717).alias("x")) for a in ANGLES])
    return p.select("fish_id", "z", F.when(F.col("z") % 2 == 1, F.reverse(pts)).otherwise(pts).alias("pts"))


def outline_volumes(spark, sf):
    ids = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fish_id")).distinct()
    return ids.select("fish_id", F.lit(30).alias("nz"), F.lit(24).alias("ny"), F.lit(24).alias("nx"))


POLY = """po AS (SELECT 'u' || user_id AS fish_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS z, least(count(*), 6) + 3.137::DOUBLE AS r FROM events GROUP BY ALL),
pts AS (SELECT fish_id, z, k, sin(a * pi() / 4) * r + 12.0531 AS y, cos(a * pi() / 4) * r + 11.9717 AS x FROM (SELECT *, CASE WHEN z % 2 = 1 THEN 7 - k ELSE k END AS a FROM po, range(0, 8) t(k)))"""
ARC = """nx AS (SELECT *, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1 FROM pts WINDOW w AS (PARTITION BY fish_id, z ORDER BY k)),
ln AS (SELECT *, sqrt((y1 - y) ** 2 + (x1 - x) ** 2) AS len FROM nx),
arc AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY fish_id, z ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(len) OVER (PARTITION BY fish_id, z) AS total FROM ln)"""
RES = """rs AS (SELECT a.fish_id, a.z, CAST(j AS INT) AS j, y + (y1 - y) * ((total * j / 96 - start) / len) AS y, x + (x1 - x) * ((total * j / 96 - start) / len) AS x
  FROM arc a, range(0, 96) s(j) WHERE total * j / 96 >= start - 1e-9 AND total * j / 96 < start + len - 1e-9)"""
ALIGN = """sl AS (SELECT fish_id, z, sum(x * py - y * px) AS area FROM (SELECT *, coalesce(lag(y) OVER w, last_value(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS py,
  coalesce(lag(x) OVER w, last_value(x) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS px FROM rs WINDOW w AS (PARTITION BY fish_id, z ORDER BY j)) GROUP BY ALL),
rf AS (SELECT fish_id, arg_min(area < 0, z) AS cw FROM sl GROUP BY ALL),
al AS (SELECT r.fish_id, r.z, CASE WHEN (area < 0) <> cw THEN 95 - j ELSE j END AS j, y, x, (area < 0) <> cw AS flipped FROM rs r JOIN sl USING (fish_id, z) JOIN rf USING (fish_id))"""
INTERP = """br AS (SELECT s.fish_id, s.z, (SELECT max(p.z) FROM po p WHERE p.fish_id = s.fish_id AND p.z <= s.z) AS z_low, (SELECT min(p.z) FROM po p WHERE p.fish_id = s.fish_id AND p.z >= s.z) AS z_high
  FROM (SELECT DISTINCT fish_id, CAST(i AS INT) AS z FROM po, range(0, 30) t(i)) s),
ip AS (SELECT b.fish_id, b.z, a.j, CASE WHEN z_low = z_high OR z_low IS NULL OR z_high IS NULL THEN a.y ELSE (1 - (b.z - z_low) / (z_high - z_low)::DOUBLE) * a.y + ((b.z - z_low) / (z_high - z_low)::DOUBLE) * c.y END AS y,
  CASE WHEN z_low = z_high OR z_low IS NULL OR z_high IS NULL THEN a.x ELSE (1 - (b.z - z_low) / (z_high - z_low)::DOUBLE) * a.x + ((b.z - z_low) / (z_high - z_low)::DOUBLE) * c.x END AS x
  FROM br b JOIN al a ON a.fish_id = b.fish_id AND a.z = coalesce(z_low, z_high) JOIN al c ON c.fish_id = b.fish_id AND c.z = coalesce(z_high, z_low) AND c.j = a.j)"""


def raster_sql(src: str, out: str, order: str) -> str:
    return f"""{out}_s AS (SELECT fish_id, z, y AS y0, x AS x0, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1 FROM {src} WINDOW w AS (PARTITION BY fish_id, z ORDER BY {order})),
{out}_c AS (SELECT fish_id, z, CAST(t.y AS INT) AS y, x0 + (t.y - y0) * (x1 - x0) / (y1 - y0) AS xc FROM {out}_s, range(0, 24) t(y) WHERE y0 <> y1 AND t.y >= least(y0, y1) AND t.y < greatest(y0, y1)),
{out} AS (SELECT fish_id, z, y, CAST(u.x AS INT) AS x FROM {out}_c, range(0, 24) u(x) WHERE xc > u.x GROUP BY ALL HAVING count(*) % 2 = 1)"""


def exploded(df):
    p = df.select("fish_id", "z", F.posexplode("pts").alias("j", "_p"))
    return p.select("fish_id", "z", "j", F.round("_p.y", 6).alias("y"), F.round("_p.x", 6).alias("x"))


@query("arc_length", "WITH " + POLY + ", " + ARC + " SELECT fish_id, z, CAST(k AS INT) AS i, round(len, 6) AS len, round(start, 6) AS start FROM arc")
def arc_length(spark, sf):
    return rounded(O.arc_length(outlines(spark, sf)).select("fish_id", "z", "i", "len", "start")).withColumn("start", F.abs("start"))


@query("resample_outline", "WITH " + ", ".join((POLY, ARC, RES)) + " SELECT fish_id, z, j, round(y, 6) AS y, round(x, 6) AS x FROM rs")
def resample_outline(spark, sf):
    return exploded(O.resample_outline(outlines(spark, sf)))


@query("align_direction", "WITH " + ", ".join((POLY, ARC, RES, ALIGN)) + " SELECT fish_id, z, j, round(y, 6) AS y, round(x, 6) AS x FROM al")
def align_direction(spark, sf):
    return exploded(O.align_direction(O.resample_outline(outlines(spark, sf))))


@query("bracket_slices", "WITH " + ", ".join((POLY, INTERP.split("),\nip AS")[0] + ")")) + " SELECT * FROM br")
def bracket_slices(spark, sf):
    return O.bracket_slices(outlines(spark, sf), outline_volumes(spark, sf))


@query("interpolate_outlines", "WITH " + ", ".join((POLY, ARC, RES, ALIGN, INTERP)) + " SELECT fish_id, z, j, round(y, 6) AS y, round(x, 6) AS x FROM ip")
def interpolate_outlines(spark, sf):
    return exploded(O.interpolate_outlines(outlines(spark, sf), outline_volumes(spark, sf)))


@query("rasterize", "WITH " + ", ".join((POLY, raster_sql("pts", "ra", "k"))) + " SELECT * FROM ra")
def rasterize(spark, sf):
    return O.rasterize(outlines(spark, sf), outline_volumes(spark, sf))


@query("masks_from_outlines", "WITH " + ", ".join((POLY, ARC, RES, ALIGN, INTERP, raster_sql("ip", "ra", "j"))) + """,
t AS (SELECT fish_id, least(greatest(z + d, 0), 29) AS z, y, x FROM ra, (VALUES (-1), (0), (1)) v(d)), m AS (SELECT fish_id, z, y, x FROM t GROUP BY ALL HAVING count(*) >= 2),
v AS (SELECT 'u' || user_id AS fish_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS z, CAST(extract(hour FROM ts) AS INT) AS y, CAST(extract(minute FROM ts) AS INT) % 24 AS x, sum(value) AS value FROM events GROUP BY ALL)
SELECT fish_id, count(*) AS n_mask, (SELECT count(*) FROM v JOIN m b USING (fish_id, z, y, x) WHERE v.fish_id = m.fish_id) AS n_brain,
 (SELECT count(*) FROM v WHERE v.fish_id = m.fish_id) - (SELECT count(*) FROM v JOIN m b USING (fish_id, z, y, x) WHERE v.fish_id = m.fish_id) AS n_skin FROM m GROUP BY fish_id""")
def masks_from_outlines(spark, sf):
    """Outlines to brain mask, brain-only and skin-only voxels, counted per sample."""
    e = table(spark, sf, "events")
    v = e.groupBy(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fish_id"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("z"),
        F.hour("ts").alias("y"), (F.minute("ts") % 24).alias("x"),
    ).agg(F.sum("value").alias("value"))
    mask, brain, skin = J.masks_from_outlines(outlines(spark, sf), outline_volumes(spark, sf), v)

    def n(df, name):
        return df.groupBy("fish_id").agg(F.count("*").alias(name))

    return n(mask, "n_mask").join(n(brain, "n_brain"), "fish_id", "left").join(n(skin, "n_skin"), "fish_id", "left").na.fill(0)


# --- crops ---------------------------------------------------------------------------

ANISO = f"{SCALE[0] / ((SCALE[1] + SCALE[2]) / 2)!r}"
SLICES = f"""mm AS (SELECT CAST(round_even(30 * CAST({ANISO} AS DOUBLE), 0) AS INT) AS m),
mp AS (SELECT CAST(i AS INT) AS i, CAST(floor(i * 29.0::DOUBLE / (m - 1) + 0.5) AS INT) AS z FROM mm, range(0, 1000) t(i) WHERE i < m),
sl AS (SELECT fish_id, 'xy' AS orientation, z AS slice_idx, y, x, label FROM blk UNION ALL
  SELECT fish_id, 'xz', y, i, x, label FROM blk JOIN mp USING (z) UNION ALL SELECT fish_id, 'yz', x, i, y, label FROM blk JOIN mp USING (z))"""


@query("label_slices", with_(*B, SLICES, body="SELECT fish_id, orientation, slice_idx, label, count(*) AS n, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x) AS BIGINT) AS sx FROM sl GROUP BY ALL"))
def label_slices(spark, sf):
    s = C.label_slices(blocks(spark, sf), vol(spark, sf))
    return s.groupBy("fish_id", "orientation", "slice_idx", "label").agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("sy"), F.sum(F.col("x").cast("long")).alias("sx")
    )


@query("stretch_image", with_(*B, f"""mm AS (SELECT CAST(round_even(30 * CAST({ANISO} AS DOUBLE), 0) AS INT) AS m), ii AS (SELECT CAST(i AS INT) AS i, i * 29.0::DOUBLE / (m - 1) AS s FROM mm, range(0, 1000) t(i) WHERE i < m),
st AS (SELECT fish_id, x AS slice_idx, y, i AS z, sum(value * (1 - abs(s - z))) AS value FROM vox, ii WHERE abs(s - z) < 1 - 1e-12 GROUP BY ALL)""", body="""
SELECT fish_id, slice_idx, y, z, round(value, 6) AS value FROM st WHERE value > 1e-6"""))
def stretch_image(spark, sf):
    """Image slices along x, blended linearly along z."""
    v = vox(spark, sf).drop("channel").join(vol(spark, sf).select("fish_id", "nz", "anisotropy"), "fish_id").withColumnRenamed("x", "slice_idx")
    return rounded(C.stretch_z(v, 1, "value", ["fish_id", "slice_idx", "y"]).filter("value > 1e-6"))


def fixed_crops(spark, sf):
    """Two 12 x 12 crops per labelled slice at places given by the slice number."""
    s = C.label_slices(blocks(spark, sf), vol(spark, sf)).select("fish_id", "orientation", "slice_idx").distinct()
    s = s.withColumn("crop_no", F.explode(F.array(F.lit(0), F.lit(1))))
    return s.withColumn("top", (F.col("slice_idx") * 3 + F.col("crop_no") * 5) % 15).withColumn("left", (F.col("slice_idx") * 5 + F.col("crop_no") * 7) % 11)


CROPS = """cr AS (SELECT DISTINCT fish_id, orientation, slice_idx, c AS crop_no, (slice_idx * 3 + c * 5) % 15 AS top, (slice_idx * 5 + c * 7) % 11 AS lft FROM sl, (VALUES (0), (1)) v(c)),
px AS (SELECT s.fish_id, s.orientation, s.slice_idx, crop_no, y - top AS y, x - lft AS x, label FROM sl s JOIN cr USING (fish_id, orientation, slice_idx) WHERE y >= top AND y < top + 12 AND x >= lft AND x < lft + 12),
vs AS (SELECT fish_id, orientation, slice_idx, crop_no, label, count(*) AS visible FROM px GROUP BY ALL), tr AS (SELECT fish_id, orientation, slice_idx, label, count(*) AS tc FROM sl GROUP BY ALL),
ct AS (SELECT vs.*, visible < 0.9 * tc AS cut FROM vs JOIN tr USING (fish_id, orientation, slice_idx, label))"""


@query("clean_truncation", with_(*B, SLICES, CROPS, body="""
SELECT fish_id, count(*) AS n_scanned, count(*) FILTER (n > 0) AS n_modified, CAST(sum(n) AS BIGINT) AS n_zeroed FROM
 (SELECT fish_id, orientation, slice_idx, crop_no, count(*) FILTER (cut) AS n FROM ct GROUP BY ALL) GROUP BY ALL"""))
def clean_truncation(spark, sf):
    s = materialize(C.label_slices(blocks(spark, sf), vol(spark, sf)))
    return C.clean_truncation(C.cut_crops(s, fixed_crops(spark, sf), 12), s)[1]


@query("clean_crops", with_(*B, SLICES, CROPS, body="""
SELECT fish_id, orientation, slice_idx, crop_no, CAST(row_number() OVER (PARTITION BY fish_id, orientation, slice_idx, crop_no ORDER BY label) AS INT) AS label, visible AS n FROM ct WHERE NOT cut AND visible >= 9"""))
def clean_crops(spark, sf):
    """Truncated and tiny labels dropped, the rest renumbered per crop."""
    s = materialize(C.label_slices(blocks(spark, sf), vol(spark, sf)))
    kept, _ = C.clean_truncation(C.cut_crops(s, fixed_crops(spark, sf), 12), s)
    return C.clean_crops(kept).groupBy("fish_id", *C.CROP, "label").agg(F.count("*").alias("n"))


@query("valid_crops", """
SELECT o_orderkey AS stem FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)""")
def valid_crops(spark, sf):
    img = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stem"), F.when(F.col("o_orderkey") % 7 == 0, 3).otherwise(2).alias("ndim"))
    msk = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stem"), F.col("l_linenumber").alias("ndim"))
    return C.valid_crops(img, msk).select("stem")


@query("bbox_crop", with_(*B, body="""
, bx AS (SELECT fish_id, label, greatest(min(z) - 2, 0) AS z0, least(max(z) + 1 + 2, 30) AS z1, greatest(min(y) - 3, 0) AS y0, min(ny) AS ny, max(y) + 1 + 3 AS y1, greatest(min(x) - 3, 0) AS x0, least(max(x) + 1 + 3, 24) AS x1
  FROM blk JOIN vol USING (fish_id) WHERE label % 5 = 0 GROUP BY ALL)
SELECT b.fish_id, b.label AS cell_label, count(*) AS n, round(sum(value), 4) AS total FROM bx b JOIN vox v ON v.fish_id = b.fish_id AND v.z >= z0 AND v.z < z1 AND v.y >= y0 AND v.y < least(y1, ny) AND v.x >= x0 AND v.x < x1 GROUP BY ALL""".strip()))
def bbox_crop(spark, sf):
    from ..operators.objects import object_info

    o = object_info(blocks(spark, sf).filter("label % 5 = 0"))
    c = C.bbox_crop(vox(spark, sf), o, vol(spark, sf), 2, 3)
    return c.groupBy("fish_id", "cell_label").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("sample_crops")
def sample_crops(spark, sf):
    s = materialize(C.label_slices(truth(spark, sf), vol(spark, sf)))
    c = C.sample_crops(s, C.slice_shapes(vol(spark, sf)), 12, 5, 40, 10)
    return c.groupBy("fish_id", "orientation").agg(F.count("*").alias("n"), F.min("gt_px").alias("min_px"), F.max("crop_no").alias("max_crop_no"))


@query("image_slices", with_(*B, f"""mm AS (SELECT CAST(round_even(30 * CAST({ANISO} AS DOUBLE), 0) AS INT) AS m), ii AS (SELECT CAST(i AS INT) AS i, i * 29.0::DOUBLE / (m - 1) AS s FROM mm, range(0, 1000) t(i) WHERE i < m),
st AS (SELECT fish_id, x, y, i AS z, sum((value + 3e-7) * (1 - abs(s - z))) AS value FROM vox, ii WHERE abs(s - z) < 1 - 1e-12 GROUP BY ALL),
im AS (SELECT fish_id, 'xy' AS orientation, z AS slice_idx, value + 3e-7 AS value FROM vox UNION ALL SELECT fish_id, 'xz', y, value FROM st UNION ALL SELECT fish_id, 'yz', x, value FROM st)""", body="""
SELECT fish_id, orientation, slice_idx, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM im WHERE floor(value) <> 0 GROUP BY ALL"""))
def image_slices(spark, sf):
    v = vox(spark, sf).withColumn("value", F.col("value") + 3e-7)
    s = C.image_slices(v, vol(spark, sf))
    return s.groupBy("fish_id", "orientation", "slice_idx").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@query("crop_set")
def crop_set(spark, sf):
    _, px, image, summary = J.crop_set(truth(spark, sf), vol(spark, sf), 16, 5, 60, 10, voxels=vox(spark, sf))
    n = px.groupBy("fish_id").agg(F.count("*").alias("n_px"))
    m = image.groupBy("fish_id").agg(F.count("*").alias("n_image_px"))
    return summary.join(n, "fish_id", "left").join(m, "fish_id", "left").na.fill(0)
