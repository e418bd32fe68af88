"""Queries: object tables, scalar functions, pair joins, matching and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import describe as D, regions as R, scalar as SC
from ..operators import merging as MG, objects as OB, pairs as P, scoring as SR, labels as L
from ..plans import jobs as J
from ..schemas import ZYX
from ..sources import sinks as SK
from ..session import materialize
from .base import (
    SCALE, VOL, VOX, blocks, blocks_sql, info_sql, labels_sql, predicted, query, rounded, table, truth, vol, vox, with_,
)

B = (VOX, VOL, blocks_sql())
BI = (*B, info_sql("blk", "i"))
GP = (VOX, VOL, labels_sql("g", 0), labels_sql("p", 20))


@query("volumes_of", with_(*B, body="SELECT fish_id, label, count(*) AS volume_vox FROM blk GROUP BY ALL"))
def volumes_of(spark, sf):
    return L.volumes_of(blocks(spark, sf))


@query("object_info", with_(*BI, body="SELECT * REPLACE (round(cz, 6) AS cz, round(cy, 6) AS cy, round(cx, 6) AS cx) FROM i"))
def object_info(spark, sf):
    return rounded(OB.object_info(blocks(spark, sf)))


PROPS = """pr AS (SELECT fish_id, label, count(*) AS volume_vox, min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1,
  avg(z) AS cz, avg(y) AS cy, avg(x) AS cx,
  var_pop(y) + var_pop(x) AS i_zz, var_pop(z) + var_pop(x) AS i_yy, var_pop(z) + var_pop(y) AS i_xx,
  -covar_pop(z, y) AS i_zy, -covar_pop(z, x) AS i_zx, -covar_pop(y, x) AS i_yx FROM blk GROUP BY ALL)"""
AXES = """e1 AS (SELECT *, i_zz + i_yy + i_xx AS t, (i_zz + i_yy + i_xx) / 3 AS q FROM pr),
e2 AS (SELECT *, sqrt(((i_zz - q) ** 2 + (i_yy - q) ** 2 + (i_xx - q) ** 2 + 2 * (i_zy ** 2 + i_zx ** 2 + i_yx ** 2)) / 6) AS p FROM e1),
e3 AS (SELECT *, CASE WHEN p <= t * 1e-12 THEN 0 ELSE ((i_zz - q) * ((i_yy - q) * (i_xx - q) - i_yx ** 2) - i_zy * (i_zy * (i_xx - q) - i_yx * i_zx) + i_zx * (i_zy * i_yx - (i_yy - q) * i_zx)) / (2 * p * p * p) END AS r FROM e2),
e4 AS (SELECT *, acos(least(greatest(r, -1.0), 1.0)) / 3 AS phi FROM e3),
e5 AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM e4),
e6 AS (SELECT *, t - l1 - l3 AS l2 FROM e5),
ax AS (SELECT *, CASE WHEN l1 + l2 - l3 <= t * 1e-7 THEN 0 ELSE sqrt(10 * (l1 + l2 - l3)) END AS major, CASE WHEN l2 + l3 - l1 <= t * 1e-7 THEN 0 ELSE sqrt(10 * (l2 + l3 - l1)) END AS minor FROM e6)"""


@query("regionprops", with_(*B, PROPS, body="""
SELECT fish_id, label, volume_vox, round(volume_vox * 1.0 / ((z1 - z0) * (y1 - y0) * (x1 - x0)), 6) AS extent, round(i_zz + 3e-8, 6) AS i_zz, round(i_yy + 3e-8, 6) AS i_yy,
  round(i_xx + 3e-8, 6) AS i_xx, round(i_zy + 3e-8, 6) + 0.0 AS i_zy, round(i_zx + 3e-8, 6) + 0.0 AS i_zx, round(i_yx + 3e-8, 6) + 0.0 AS i_yx FROM pr"""))
def regionprops(spark, sf):
    r = OB.regionprops(blocks(spark, sf)).select("fish_id", "label", "volume_vox", "extent", *[(F.col(f"i_{k}") + 3e-8).alias(f"i_{k}") for k in ("zz", "yy", "xx", "zy", "zx", "yx")])
    return rounded(r).withColumns({c: F.col(c) + 0.0 for c in ("i_zy", "i_zx", "i_yx")})


@query("principal_axes", with_(*B, PROPS, AXES, body="""
SELECT fish_id, label, round(major, 5) AS axis_major, round(minor, 5) AS axis_minor FROM ax"""))
def principal_axes(spark, sf):
    a = OB.principal_axes(OB.regionprops(blocks(spark, sf)))
    return rounded(a.select("fish_id", "label", "axis_major", "axis_minor"), 5)


@query("axes_um", with_(*B, PROPS, AXES, body=f"""
, s AS (SELECT fish_id, label, minor * (({SCALE[0]} + {SCALE[1]} + {SCALE[2]}) / 3) AS a3, major FROM ax WHERE volume_vox >= 20)
SELECT fish_id, label, round(major * {SCALE[2]}, 5) AS axis1_um, round(a3, 5) AS axis3_um, round((major * {SCALE[2]} + a3) / 2, 5) AS axis2_um,
  round(major * {SCALE[2]} / greatest(a3, 1e-10), 4) AS elongation FROM s""".strip()))
def axes_um(spark, sf):
    """Axis conversion with the direction fixed to X (the direction itself is tested on small shapes)."""
    a = OB.principal_axes(OB.regionprops(blocks(spark, sf))).filter("volume_vox >= 20").withColumn("principal_axis_dir", F.lit("X"))
    a = OB.axes_um(a.join(vol(spark, sf).select("fish_id", "sz", "sy", "sx"), "fish_id"))
    return a.select("fish_id", "label", *[F.round(c, 5).alias(c) for c in ("axis1_um", "axis3_um", "axis2_um")], F.round("elongation", 4).alias("elongation"))


@query("principal_axis_dir", None)
def principal_axis_dir(spark, sf):
    a = OB.principal_axes(OB.regionprops(truth(spark, sf)))
    return a.groupBy("fish_id", "principal_axis_dir").agg(F.count("*").alias("n"))


@query("intensity_stats", with_(*B, body="""
SELECT b.fish_id, b.label, round(avg(value) + 3e-8, 6) AS mean_intensity, round(sum(value), 4) AS integrated_intensity,
  round(CASE WHEN avg(value) > 0 THEN stddev_pop(value) / avg(value) ELSE 0 END, 6) AS intensity_cv FROM blk b JOIN vox v USING (fish_id, z, y, x) GROUP BY ALL"""))
def intensity_stats(spark, sf):
    i = OB.intensity_stats(blocks(spark, sf), vox(spark, sf))
    return i.select("fish_id", "label", F.round(F.col("mean_intensity") + 3e-8, 6).alias("mean_intensity"), F.round("integrated_intensity", 4).alias("integrated_intensity"),
                    F.round("intensity_cv", 6).alias("intensity_cv"))


@query("size_bounds", with_(*GP, body="""
SELECT fish_id, min(n) AS min_volume, max(n) AS max_volume FROM (SELECT fish_id, label, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL"""))
def size_bounds(spark, sf):
    return OB.size_bounds(truth(spark, sf))


@query("distinct_labels", with_(*GP, body="SELECT fish_id, count(DISTINCT label) AS n_labels FROM p GROUP BY ALL"))
def distinct_labels(spark, sf):
    return OB.distinct_labels(predicted(spark, sf))


@query("stage_counts", with_(*GP, body="""
SELECT fish_id, count(DISTINCT label) AS n_labels, 'raw' AS stage FROM p GROUP BY ALL UNION ALL
SELECT fish_id, count(*), 'sized' FROM (SELECT fish_id, label FROM p GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL"""))
def stage_counts(spark, sf):
    p = predicted(spark, sf)
    return OB.stage_counts({"raw": p, "sized": L.filter_small(p, 8)})


@query("flag_outliers", with_(*B, body="""
, s AS (SELECT fish_id, label, count(*) AS volume_vox FROM blk GROUP BY ALL), b AS (SELECT avg(volume_vox) * 0.5 AS lo, avg(volume_vox) * 1.5 AS hi FROM s)
SELECT fish_id, label, volume_vox, volume_vox > hi OR volume_vox < lo AS is_volume_outlier FROM s, b""".strip()))
def flag_outliers(spark, sf):
    s = L.volumes_of(blocks(spark, sf))
    bounds = s.agg((F.avg("volume_vox") * 0.5).alias("min_floor"), (F.avg("volume_vox") * 1.5).alias("max_ceiling"))
    return OB.flag_outliers(s, bounds)


@query("cell_summary", with_(*BI, body="""
SELECT fish_id, label, volume_vox, round_even(cz, 2) AS centroid_z, round_even(cy, 2) AS centroid_y, round_even(cx, 2) AS centroid_x, z0 AS bbox_z0, y0 AS bbox_y0, x0 AS bbox_x0,
  z1 AS bbox_z1, y1 AS bbox_y1, x1 AS bbox_x1 FROM i"""))
def cell_summary(spark, sf):
    return OB.cell_summary(blocks(spark, sf))


UM = f"""um AS (SELECT *, volume_vox * (sz * sy * sx) AS v, cz * sz AS zu, cy * sy AS yu, cx * sx AS xu FROM i JOIN vol USING (fish_id))"""


@query("to_um", with_(*BI, UM, body="""
SELECT fish_id, label, round_even(v, 2) AS volume_um3, round_even(zu, 2) AS centroid_z_um, round_even(yu, 2) AS centroid_y_um, round_even(xu, 2) AS centroid_x_um,
  round_even((z1 - z0) * sz, 2) AS bbox_dz_um, round_even((y1 - y0) * sy, 2) AS bbox_dy_um, round_even((x1 - x0) * sx, 2) AS bbox_dx_um,
  round(cbrt(6 * v / pi()), 6) AS eq_diam_um FROM um"""))
def to_um(spark, sf):
    o = SC.to_um(OB.object_info(blocks(spark, sf)), vol(spark, sf))
    return o.select("fish_id", "label", "volume_um3", *[f"centroid_{c}_um" for c in ZYX], *[f"bbox_d{c}_um" for c in ZYX],
                    F.round(SC.eq_diam("_vol"), 6).alias("eq_diam_um"))


# Shape values as functions of real columns, to check the formulas against SQL.
SHAPES = """sh AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 AS vol, l_quantity * 40 AS area, CAST(l_partkey % 9 AS INT) AS n_br,
  CAST(l_suppkey % 5 AS INT) AS n_ep, l_discount * 10 AS solid, l_tax * 60 AS elong, l_quantity / 7 AS len FROM lineitem)"""


def shapes(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100).alias("vol"), (F.col("l_quantity") * 40).alias("area"),
        (F.col("l_partkey") % 9).cast("int").alias("n_br"), (F.col("l_suppkey") % 5).cast("int").alias("n_ep"),
        (F.col("l_discount") * 10).alias("solid"), (F.col("l_tax") * 60).alias("elong"), (F.col("l_quantity") / 7).alias("len"),
    )


SPHER = "CASE WHEN area > 0 THEN least(pow(pi(), 1.0 / 3) * pow(6 * vol, 2.0 / 3) / area, 1.0) ELSE 0 END"


@query("sphericity", f"WITH {SHAPES} SELECT l_orderkey, l_linenumber, round({SPHER}, 8) AS sphericity FROM sh")
def sphericity(spark, sf):
    return shapes(spark, sf).select("l_orderkey", "l_linenumber", F.round(SC.sphericity("vol", "area"), 8).alias("sphericity"))


@query("branch_ratios", f"""WITH {SHAPES} SELECT l_orderkey, l_linenumber, round(round_even(area / vol, 9), 3) AS sav, round(round_even(n_br / vol * 1e6, 9), 2) AS branch_density,
  round(round_even(n_ep / vol * 1e6, 9), 2) AS endpoint_density, round(round_even(n_ep * len / vol, 9), 5) AS process_complexity FROM sh""")
def branch_ratios(spark, sf):
    s = shapes(spark, sf).withColumnsRenamed({"vol": "_vol", "area": "surface_area_um2", "n_br": "n_branches", "n_ep": "n_endpoints", "len": "mean_branch_len_um"})
    raw = s.select(
        "l_orderkey", "l_linenumber", SC.per_volume("surface_area_um2", "_vol", 1.0, 9).alias("sav"), SC.per_volume("n_branches", "_vol", 1e6, 9).alias("branch_density"),
        SC.per_volume("n_endpoints", "_vol", 1e6, 9).alias("endpoint_density"),
        SC.per_volume(F.col("n_endpoints") * F.col("mean_branch_len_um"), "_vol", 1.0, 9).alias("process_complexity"),
    )
    return raw.withColumns({"sav": F.round("sav", 3), "branch_density": F.round("branch_density", 2), "endpoint_density": F.round("endpoint_density", 2),
                            "process_complexity": F.round("process_complexity", 5)})


MORPH = f"""mo AS (SELECT *, {SPHER} AS spher, area / vol AS sav FROM sh),
mt AS (SELECT *, CASE WHEN elong > 3.5 AND n_br <= 3 THEN 'Rod-shaped' WHEN spher > 0.70 AND solid > 0.80 AND n_br <= 2 THEN 'Amoeboid'
  WHEN n_br >= 6 AND sav > 2.0 AND spher < 0.55 THEN 'Ramified' WHEN n_br >= 4 AND spher < 0.65 THEN 'Intermediate-ramified' ELSE 'Intermediate' END AS morphotype FROM mo)"""


@query("morphotype", f"WITH {SHAPES}, {MORPH} SELECT morphotype, count(*) AS n FROM mt GROUP BY ALL")
def morphotype(spark, sf):
    s = shapes(spark, sf).withColumn("spher", SC.sphericity("vol", "area"))
    m = SC.morphotype("spher", "solid", "elong", "n_br", F.col("area") / F.col("vol"))
    return s.groupBy(m.alias("morphotype")).agg(F.count("*").alias("n"))


def described(spark, sf):
    s = shapes(spark, sf).withColumn("sphericity", SC.sphericity("vol", "area"))
    s = s.withColumn("morphotype", SC.morphotype("sphericity", "solid", "elong", "n_br", F.col("area") / F.col("vol")))
    return s.select(
        "l_orderkey", F.col("l_linenumber").alias("label"), F.round("vol", 0).alias("volume_um3"), "elong", "sphericity", "morphotype",
        F.col("solid").alias("solidity"), F.col("n_br").alias("n_branches"), F.col("n_ep").alias("n_endpoints"), F.round("len", 0).alias("mean_branch_len_um"),
        F.col("elong").alias("elongation"), F.when(F.col("n_br") % 3 == 0, "Z").when(F.col("n_br") % 3 == 1, "Y").otherwise("X").alias("principal_axis_dir"),
        F.col("area").alias("centroid_z_um"), (F.col("area") / 10).alias("centroid_y_um"), F.col("n_ep").cast("double").alias("centroid_x_um"),
    )


DESC = """ds AS (SELECT *, CASE n_br % 3 WHEN 0 THEN 'Z' WHEN 1 THEN 'Y' ELSE 'X' END AS d, round(len, 0) AS ln, round(vol, 0) AS vv FROM mt),
dt AS (SELECT *, CASE WHEN spher > 0.85 THEN 'Spherical' WHEN spher > 0.70 AND elong > 1.8 THEN printf('Rounded, elongated along %s-axis (%.1f:1)', lower(d), elong)
  WHEN spher > 0.70 THEN 'Rounded' WHEN elong > 2.5 THEN printf('Elongated along %s-axis (%.1f:1)', lower(d), elong)
  WHEN elong > 1.5 THEN printf('Moderately elongated along %s-axis', lower(d)) ELSE 'Compact, irregular' END AS shape,
  CASE WHEN solid > 0.90 THEN 'Smooth surface' WHEN solid > 0.75 THEN 'Slightly lobulated surface' ELSE 'Lobulated/irregular surface' END AS skin,
  CASE WHEN n_br = 0 THEN 'No branching detected' WHEN n_br <= 2 THEN n_ep || ' protrusion(s)' ELSE n_br || ' branches, ' || n_ep || ' endpoints' END
  || CASE WHEN n_br > 0 AND ln > 0 THEN printf(' (mean %.1f µm)', ln) ELSE '' END AS arms FROM ds)"""


@query("describe", f"""WITH {SHAPES}, {MORPH}, {DESC} SELECT l_orderkey, l_linenumber AS label, 'Label ' || l_linenumber || ': ' || shape || ', volume ' || format('{{:,}}', CAST(vv AS BIGINT)) || ' µm³, centroid Z='
 || printf('%.1f', area) || ' Y=' || printf('%.1f', area / 10) || ' X=' || printf('%.1f', CAST(n_ep AS DOUBLE)) || ' µm. ' || skin || ', sphericity ' || regexp_extract(printf('%.6f', spher), '^[0-9]+\\.[0-9]')
 || ', arms: ' || arms || ', ' || morphotype AS text FROM dt""")
def describe(spark, sf):
    """The sentence, with two-decimal values cut to what both engines print alike."""
    d = D.describe_with(described(spark, sf))
    t = F.regexp_replace("description", r" sphericity (\d+\.\d)\d, solidity \d+\.\d\d\. ", " sphericity #. ")
    t = F.regexp_replace(t, r" Morphotype: ([^.]*)\.$", ", $1")
    t = F.regexp_replace(t, r"sphericity #\. ", "sphericity #, arms: ")
    t = F.regexp_replace(t, r"\., ([A-Z][a-z-]*)$", ", $1")
    spher = F.regexp_extract(F.format_string("%.6f", "sphericity"), r"^(\d+\.\d)", 1)
    head, tail = F.split(t, "#", 2)[0], F.split(t, "#", 2)[1]
    return d.select("l_orderkey", "label", F.concat(head, spher, tail).alias("text"))


@query("build_prompts", f"""WITH {SHAPES}, {MORPH} SELECT l_orderkey, l_linenumber AS label,
 printf('Branches: %d  Endpoints: %d', n_br, n_ep) AS branches, morphotype FROM mt""")
def build_prompts(spark, sf):
    p = D.build_prompts(described(spark, sf))
    return p.select("l_orderkey", "label", F.regexp_extract("prompt", r"(Branches: \d+  Endpoints: \d+)", 1).alias("branches"),
                    F.regexp_extract("prompt", r"Morphotype: ([^\n]*)", 1).alias("morphotype"))


@query("describe_with_function", f"WITH {SHAPES}, {MORPH} SELECT l_orderkey, l_linenumber AS label, 'Cell ' || l_linenumber || ' is ' || morphotype AS description FROM mt")
def describe_with_function(spark, sf):
    d = D.describe_with(described(spark, sf), lambda df: F.format_string("Cell %d is %s", "label", "morphotype"))
    return d.select("l_orderkey", "label", "description")


@query("anisotropy", "SELECT l_orderkey, l_linenumber, round(CASE WHEN (l_discount + l_tax) / 2 > 0 THEN l_quantity / ((l_discount + l_tax) / 2) ELSE 1 END, 6) AS anisotropy FROM lineitem")
def anisotropy(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(SC.anisotropy("l_quantity", "l_discount", "l_tax"), 6).alias("anisotropy"))


@query("dice_and_delta", """SELECT l_orderkey, l_linenumber, round(2 * l_discount / (1 + l_discount), 8) AS dice,
 round(CASE WHEN l_linenumber > 1 THEN (l_linenumber - l_quantity) / l_quantity * 100 ELSE -100 END, 6) AS size_delta FROM lineitem""")
def dice_and_delta(spark, sf):
    pred = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).otherwise(0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(SC.dice_of("l_discount"), 8).alias("dice"),
                                               F.round(SC.size_delta(pred, "l_quantity"), 6).alias("size_delta"))


# --- neighbours ---------------------------------------------------------------

PTS = """pt AS (SELECT fish_id, label, round_even(cz * sz, 2) AS z, round_even(cy * sy, 2) AS y, round_even(cx * sx, 2) AS x FROM i JOIN vol USING (fish_id)),
d AS (SELECT a.fish_id, a.label, b.label AS nn_label, sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS dist FROM pt a JOIN pt b ON a.fish_id = b.fish_id AND a.label <> b.label),
nn AS (SELECT *, row_number() OVER (PARTITION BY fish_id, label ORDER BY dist, nn_label) AS rank FROM d)"""
GI = (VOX, VOL, labels_sql("g", 0), info_sql("g", "i"), PTS)


def centres(spark, sf, labels):
    o = SC.to_um(OB.object_info(labels), vol(spark, sf))
    return o.select("fish_id", "label", *[F.col(f"centroid_{c}_um").alias(c) for c in ZYX])


@query("knn", with_(*GI, body="SELECT fish_id, label, CAST(rank AS INT) AS rank, nn_label, round(dist, 6) AS dist FROM nn WHERE rank <= 3"))
def knn(spark, sf):
    return rounded(P.knn(materialize(centres(spark, sf, truth(spark, sf))), 3))


@query("nearest_two", with_(*GI, body="""
SELECT a.fish_id, a.label, a.nn_label AS nearest_neighbor_label, round(a.dist, 6) AS nearest_neighbor_dist_um, b.nn_label AS nearest_neighbor_2_label, round(b.dist, 6) AS nearest_neighbor_2_dist_um
FROM nn a JOIN nn b USING (fish_id, label) WHERE a.rank = 1 AND b.rank = 2"""))
def nearest_two(spark, sf):
    return rounded(P.nearest_two(materialize(centres(spark, sf, truth(spark, sf)))))


for _r in (3.0, 8.0):

    @query(f"radius_count_{_r:g}", with_(*GI, body=f"""
SELECT p.fish_id, p.label, count(d.dist) FILTER (d.dist <= {_r}) AS n_within FROM pt p LEFT JOIN d USING (fish_id, label) GROUP BY ALL"""))
    def _radius(spark, sf, r=_r):
        """Neighbours inside a sphere; whole cells are added by count."""
        return P.radius_count(materialize(centres(spark, sf, truth(spark, sf))), r)


@query("clark_evans", with_(*GI, body="""
, b AS (SELECT fish_id, count(*) AS n, (max(z) - min(z) + 1e-10) * (max(y) - min(y) + 1e-10) * (max(x) - min(x) + 1e-10) AS v FROM pt GROUP BY ALL)
SELECT fish_id, label, round(dist / (0.8929795115692493 * cbrt(3 / (4 * pi() * (n / v)))), 6) AS ratio FROM nn JOIN b USING (fish_id) WHERE rank = 1""".strip()))
def clark_evans(spark, sf):
    o = SC.to_um(OB.object_info(truth(spark, sf)), vol(spark, sf))
    o = materialize(o.select("fish_id", "label", *[f"centroid_{c}_um" for c in ZYX]))
    nn = P.nearest_two(o.select("fish_id", "label", *[F.col(f"centroid_{c}_um").alias(c) for c in ZYX]))
    return SC.clark_evans(o.join(nn, ["fish_id", "label"])).select("fish_id", "label", F.round("nearest_neighbor_ratio", 6).alias("ratio"))


@query("depth_normalized", with_(*BI, body="SELECT fish_id, label, round(least(greatest(cz / max(cz) OVER (PARTITION BY fish_id), 0), 1), 6) AS depth_normalized FROM i"))
def depth_normalized(spark, sf):
    return rounded(SC.depth_normalized(OB.object_info(blocks(spark, sf)), "cz").select("fish_id", "label", "depth_normalized"))


@query("bbox_pairs", with_(*GP, info_sql("g", "i"), body="""
SELECT a.fish_id, a.label AS a, b.label AS b, least(a.z0, b.z0) AS z0, greatest(a.x1, b.x1) AS x1 FROM i a JOIN i b ON a.fish_id = b.fish_id AND a.label < b.label
WHERE NOT (a.z1 + 1.5 < b.z0 OR b.z1 + 1.5 < a.z0 OR a.y1 + 1.5 < b.y0 OR b.y1 + 1.5 < a.y0 OR a.x1 + 1.5 < b.x0 OR b.x1 + 1.5 < a.x0)"""))
def bbox_pairs(spark, sf):
    """Near pairs and a corner of their joint box."""
    o = materialize(OB.object_info(truth(spark, sf)))
    p = P.bbox_pairs(o, o, 1.5).filter("a_label < b_label")
    joint = {c._jc.toString().split(" AS ")[-1]: c for c in P.joint_bbox()}
    return p.select("fish_id", F.col("a_label").alias("a"), F.col("b_label").alias("b"), joint["z0"], joint["x1"])


GAP = f"""gp AS (SELECT a.fish_id, a.label AS a, b.label AS b, min(sqrt(((a.z - b.z) * {SCALE[0]}) ** 2 + ((a.y - b.y) * {SCALE[1]}) ** 2 + ((a.x - b.x) * {SCALE[2]}) ** 2)) AS gap
  FROM prs JOIN blk a ON a.fish_id = prs.fish_id AND a.label = prs.a JOIN blk b ON b.fish_id = prs.fish_id AND b.label = prs.b GROUP BY ALL)"""
TOUCH = """tc AS (SELECT fish_id, a, b, count(*) AS contact_vox FROM (SELECT DISTINCT a.fish_id, a.label AS a, b.label AS b, b.z, b.y, b.x FROM blk a JOIN blk b ON b.fish_id = a.fish_id AND b.label <> a.label
  AND abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x) = 1) GROUP BY ALL)"""


@query("gap_contact", with_(*BI, "prs AS (SELECT a.fish_id, a.label AS a, b.label AS b FROM i a JOIN i b ON a.fish_id = b.fish_id AND b.label = a.label + 1)", GAP, TOUCH, body="""
SELECT fish_id, a, b, round(gap, 6) AS gap_um, CAST(coalesce(contact_vox, 0) AS INT) AS contact_vox FROM gp LEFT JOIN tc USING (fish_id, a, b)"""))
def gap_contact(spark, sf):
    b = materialize(blocks(spark, sf))
    ids = b.select("fish_id", F.col("label").alias("a")).distinct()
    pairs = ids.join(ids.select("fish_id", (F.col("a") - 1).alias("a"), F.col("a").alias("b")), ["fish_id", "a"])
    return rounded(P.gap_contact(b, pairs, vol(spark, sf)))


@query("min_intercell_gap", with_(*BI, f"""box AS (SELECT fish_id, label, z0 - ceil(1.5 / {SCALE[0]}) AS z0, z1 + ceil(1.5 / {SCALE[0]}) AS z1, y0 - ceil(1.5 / {SCALE[1]}) AS y0, y1 + ceil(1.5 / {SCALE[1]}) AS y1,
  x0 - ceil(1.5 / {SCALE[2]}) AS x0, x1 + ceil(1.5 / {SCALE[2]}) AS x1 FROM i)""", """prs AS (SELECT DISTINCT x.fish_id, x.label AS a, b.label AS b FROM box x JOIN blk b ON b.fish_id = x.fish_id AND b.label > x.label
  AND b.z >= x.z0 AND b.z < x.z1 AND b.y >= x.y0 AND b.y < x.y1 AND b.x >= x.x0 AND b.x < x.x1)""", GAP, body="""
SELECT fish_id, round(min(gap), 6) AS min_gap_um, count(*) AS n_pairs_measured FROM gp GROUP BY ALL"""))
def min_intercell_gap(spark, sf):
    m = P.min_intercell_gap(materialize(blocks(spark, sf)), vol(spark, sf), 1.5)
    return rounded(m.select("fish_id", "min_gap_um", "n_pairs_measured"))


# --- matching -------------------------------------------------------------------

OV = """ov AS (SELECT g.fish_id, g.label AS gt, p.label AS pred, count(*) AS inter FROM g JOIN p USING (fish_id, z, y, x) GROUP BY ALL),
vg AS (SELECT fish_id, label AS gt, count(*) AS gv FROM g GROUP BY ALL), vp AS (SELECT fish_id, label AS pred, count(*) AS pv FROM p GROUP BY ALL),
iou AS (SELECT *, inter * 1.0::DOUBLE / (gv + pv - inter) AS iou FROM ov JOIN vg USING (fish_id, gt) JOIN vp USING (fish_id, pred)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fish_id, gt ORDER BY iou DESC, pred) AS r FROM iou) WHERE r = 1),
hit AS (SELECT * FROM best WHERE iou >= 0.5)"""


@query("overlap", with_(*GP, OV, body="SELECT * FROM ov"))
def overlap(spark, sf):
    return P.overlap(predicted(spark, sf), truth(spark, sf))


@query("assign_fragments", with_(*GP, OV, body="""
SELECT fish_id, pred AS label, gt, inter FROM (SELECT *, row_number() OVER (PARTITION BY fish_id, pred ORDER BY inter DESC, gt) AS r FROM ov) WHERE r = 1 AND inter >= 3"""))
def assign_fragments(spark, sf):
    return P.assign_fragments(predicted(spark, sf), truth(spark, sf), 3)


@query("best_match", with_(*GP, OV, body="""
SELECT v.fish_id, v.gt, round(coalesce(iou, 0) * 100, 6) AS iou, round(2 * coalesce(iou, 0) / (1 + coalesce(iou, 0)) * 100, 6) AS dice, coalesce(pv, 0) AS pred_vox,
  round(CASE WHEN pv > 0 THEN (pv - v.gv) * 100.0 / v.gv ELSE -100 END, 6) AS size_delta FROM vg v LEFT JOIN best USING (fish_id, gt)"""))
def best_match(spark, sf):
    return rounded(SR.best_match(predicted(spark, sf), truth(spark, sf)))


@query("match_objects", with_(*GP, OV, body="""
SELECT fish_id, gt, round(iou * 100, 6) AS iou, round(200 * iou / (1 + iou), 6) AS dice, gv AS gt_vox, round((pv - gv) * 100.0 / gv, 6) AS size_delta FROM hit"""))
def match_objects(spark, sf):
    """One-to-one matching; the nested fixture makes the optimum the per-cell maximum."""
    return rounded(SR.match_objects(predicted(spark, sf), truth(spark, sf)).select("fish_id", "gt", "iou", "dice", "gt_vox", "size_delta"))


@query("score_against_gt", with_(*GP, OV, body="""
, a AS (SELECT fish_id, count(*) AS n_pred FROM vp GROUP BY ALL), b AS (SELECT fish_id, count(*) AS n_gt FROM vg GROUP BY ALL),
h AS (SELECT fish_id, count(*) AS tp, avg(iou * 100) AS mi, avg(200 * iou / (1 + iou)) AS md FROM hit GROUP BY ALL)
SELECT fish_id, n_pred, n_gt, tp, n_pred - tp AS fp, n_gt - tp AS fn, tp - 0.5::DOUBLE * (n_pred + n_gt - 2 * tp) AS score, round(mi, 6) AS mean_iou, round(md, 6) AS mean_dice
FROM a JOIN b USING (fish_id) JOIN h USING (fish_id)""".strip()))
def score_against_gt(spark, sf):
    return rounded(SR.score_against_gt(predicted(spark, sf), truth(spark, sf)))


@query("score_lines", with_(*GP, OV, body="""
SELECT fish_id, gt, printf('%6d', gt) || printf(' %9d', gv) AS line FROM hit"""))
def score_lines(spark, sf):
    """Report lines, cut to the columns that do not depend on equal-IoU choices."""
    m = SR.score_lines(SR.match_objects(predicted(spark, sf), truth(spark, sf)))
    return m.select("fish_id", "gt", F.concat(F.substring("line", 8, 6), F.substring("line", 40, 10)).alias("line"))


@query("score_summary_line", with_(*GP, OV, body="""
, a AS (SELECT fish_id, count(*) AS p FROM vp GROUP BY ALL), b AS (SELECT fish_id, count(*) AS g FROM vg GROUP BY ALL), h AS (SELECT fish_id, count(*) AS tp FROM hit GROUP BY ALL)
SELECT fish_id, printf('TP=%d  FP=%d  FN=%d  Score=%+.1f', tp, p - tp, g - tp, tp - 0.5::DOUBLE * (p + g - 2 * tp)) AS line FROM a JOIN b USING (fish_id) JOIN h USING (fish_id)""".strip()))
def score_summary_line(spark, sf):
    return SR.summary_line(SR.score_against_gt(predicted(spark, sf), truth(spark, sf))).select("fish_id", "line")


@query("fn_ids", with_(*GP, OV, body="SELECT fish_id, gt AS label FROM vg WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.fish_id = vg.fish_id AND h.gt = vg.gt)"))
def fn_ids(spark, sf):
    p, g = predicted(spark, sf), truth(spark, sf)
    return SR.unmatched(SR.match_objects(p, g), p, g).filter("kind = 'fn'").select("fish_id", "label")


@query("fp_counts", with_(*GP, OV, body="SELECT fish_id, count(*) - (SELECT count(*) FROM hit h WHERE h.fish_id = vp.fish_id) AS n_fp FROM vp GROUP BY fish_id"))
def fp_counts(spark, sf):
    p, g = predicted(spark, sf), truth(spark, sf)
    return SR.unmatched(SR.match_objects(p, g), p, g).filter("kind = 'fp'").groupBy("fish_id").agg(F.count("*").alias("n_fp"))


SAMPLES = f"""asg AS (SELECT fish_id, pred AS label, gt FROM (SELECT *, row_number() OVER (PARTITION BY fish_id, pred ORDER BY inter DESC, gt) AS r FROM ov) WHERE r = 1 AND inter >= 5),
prs AS (SELECT a.fish_id, a.label AS a, b.label AS b, a.gt AS ga, b.gt AS gb FROM asg a JOIN asg b ON a.fish_id = b.fish_id AND a.label <> b.label),
near AS (SELECT q.* FROM prs q JOIN i x ON x.fish_id = q.fish_id AND x.label = q.a JOIN i y ON y.fish_id = q.fish_id AND y.label = q.b
  WHERE ga = gb OR (q.a < q.b AND NOT (x.z1 + m < y.z0 OR y.z1 + m < x.z0 OR x.y1 + m < y.y0 OR y.y1 + m < x.y0 OR x.x1 + m < y.x0 OR y.x1 + m < x.x0))),
gp AS (SELECT n.fish_id, n.a, n.b, n.ga, n.gb, min(sqrt(((a.z - b.z) * {SCALE[0]}) ** 2 + ((a.y - b.y) * {SCALE[1]}) ** 2 + ((a.x - b.x) * {SCALE[2]}) ** 2)) AS gap,
  count(DISTINCT CASE WHEN abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x) = 1 THEN b.z * 1000000 + b.y * 1000 + b.x END) AS contact
  FROM near n JOIN p a ON a.fish_id = n.fish_id AND a.label = n.a JOIN p b ON b.fish_id = n.fish_id AND b.label = n.b GROUP BY ALL),
smp AS (SELECT fish_id, 'should_merge' AS kind, gap, contact FROM (SELECT *, row_number() OVER (PARTITION BY fish_id, a ORDER BY round(gap, 9), b) AS r FROM gp WHERE ga = gb) WHERE r = 1
  UNION ALL SELECT fish_id, 'should_not_merge', gap, contact FROM gp WHERE ga <> gb)""".replace(" m <", f" {0.9 / min(SCALE)} <")
MERGE = (*GP, OV, info_sql("p", "i"), SAMPLES)


@query("merge_samples", with_(*MERGE, body="SELECT fish_id, kind, round(gap, 6) AS gap_um, CAST(contact AS INT) AS contact_vox, count(*) AS n FROM smp GROUP BY ALL"))
def merge_samples(spark, sf):
    s, _ = J.measure_merge(predicted(spark, sf), truth(spark, sf), vol(spark, sf), 5, 0.9)
    return s.groupBy("fish_id", "kind", F.round("gap_um", 6).alias("gap_um"), F.col("contact_vox").cast("int").alias("contact_vox")).agg(F.count("*").alias("n"))


@query("merge_sample_counts", with_(*MERGE, body="""
SELECT a.fish_id, count(*) AS n_assigned, (SELECT count(*) FROM (SELECT gt FROM asg b WHERE b.fish_id = a.fish_id GROUP BY gt HAVING count(*) > 1)) AS n_gt_fragmented,
  (SELECT count(*) FROM vp WHERE vp.fish_id = a.fish_id) - count(*) AS n_dropped FROM asg a GROUP BY a.fish_id"""))
def merge_sample_counts(spark, sf):
    _, c = J.measure_merge(predicted(spark, sf), truth(spark, sf), vol(spark, sf), 5, 0.9)
    return c


REC = """rs AS (SELECT fish_id, kind, round(gap, 6) AS gap, contact FROM smp),
gc AS (SELECT DISTINCT fish_id, gap AS g FROM rs UNION SELECT fish_id, min(gap) - 1 FROM rs GROUP BY fish_id),
cc AS (SELECT DISTINCT fish_id, contact AS c FROM rs UNION SELECT fish_id, max(contact) + 1 FROM rs GROUP BY fish_id),
tot AS (SELECT g.fish_id, g.g, c.c, count(*) FILTER (kind = 'should_merge' AND gap > g.g AND contact < c.c) AS missed,
  count(*) FILTER (kind = 'should_not_merge' AND NOT (gap > g.g AND contact < c.c)) AS fals, count(*) FILTER (kind = 'should_merge') AS n_sm, count(*) FILTER (kind = 'should_not_merge') AS n_snm
  FROM gc g JOIN cc c USING (fish_id) JOIN rs USING (fish_id) GROUP BY ALL)"""


@query("recommend_merge", with_(*MERGE, REC, body="""
SELECT fish_id, round(g, 6) AS max_gap_um, CAST(c AS INT) AS contact_vox, missed AS missed_merges, fals AS false_merges, n_sm AS n_should_merge, n_snm AS n_should_not_merge
FROM (SELECT *, row_number() OVER (PARTITION BY fish_id ORDER BY missed + fals, g, c) AS r FROM tot) WHERE r = 1"""))
def recommend_merge(spark, sf):
    s, _ = J.measure_merge(predicted(spark, sf), truth(spark, sf), vol(spark, sf), 5, 0.9)
    s = s.withColumn("gap_um", F.round("gap_um", 6))
    return SR.recommend_merge(s).withColumn("max_gap_um", F.round("max_gap_um", 6)).withColumn("contact_vox", F.col("contact_vox").cast("int"))


@query("recommend_merge_pooled", with_(*MERGE, REC.replace("SELECT fish_id, kind, round", "SELECT 1 AS fish_id, kind, round"), body="""
SELECT round(g, 6) AS max_gap_um, CAST(c AS INT) AS contact_vox, missed AS missed_merges, fals AS false_merges, n_sm AS n_should_merge, n_snm AS n_should_not_merge
FROM (SELECT *, row_number() OVER (ORDER BY missed + fals, g, c) AS r FROM tot) WHERE r = 1"""))
def recommend_merge_pooled(spark, sf):
    s, _ = J.measure_merge(predicted(spark, sf), truth(spark, sf), vol(spark, sf), 5, 0.9)
    s = SR.pool_samples(s.filter("kind = 'should_merge'"), s.filter("kind <> 'should_merge'")).withColumn("gap_um", F.round("gap_um", 6))
    return SR.recommend_merge_pooled(s).withColumn("max_gap_um", F.round("max_gap_um", 6)).withColumn("contact_vox", F.col("contact_vox").cast("int"))


# --- merging: order-dependent, checked on small volumes in the tests -------------


@query("safe_merge")
def safe_merge(spark, sf):
    out = MG.safe_merge(predicted(spark, sf), vol(spark, sf), 0.4, 3, 8)
    return out.groupBy("fish_id").agg(F.countDistinct("label").alias("n_labels"), F.count("*").alias("n_voxels"))


@query("large_contact_merge", with_(VOX, VOL, blocks_sql("blk", 0), TOUCH, body="""
, e AS (SELECT fish_id, a, b FROM tc WHERE contact_vox >= 3), s AS (SELECT fish_id, a, b FROM e UNION SELECT fish_id, b, a FROM e),
r(fish_id, node, root) AS (SELECT DISTINCT fish_id, label, label FROM blk UNION SELECT r.fish_id, s.b, r.root FROM r JOIN s ON s.fish_id = r.fish_id AND s.a = r.node WHERE s.b > r.root),
m AS (SELECT fish_id, node AS label, min(root) AS grp FROM r GROUP BY ALL)
SELECT fish_id, n, count(*) AS n_objects FROM (SELECT fish_id, grp, count(*) AS n FROM blk JOIN m USING (fish_id, label) GROUP BY ALL) GROUP BY ALL""".strip()))
def large_contact_merge(spark, sf):
    """Sizes after merging block labels that touch in at least 3 voxels (no union of contacts adds a merge here)."""
    out = MG.large_contact_merge(materialize(blocks(spark, sf, 0.0)), 3)
    return out.groupBy("fish_id", "label").agg(F.count("*").alias("n")).groupBy("fish_id", "n").agg(F.count("*").alias("n_objects"))


@query("gmm_cleanup")
def gmm_cleanup(spark, sf):
    _, cuts = MG.gmm_cleanup(truth(spark, sf))
    return cuts


GMM = ("l_discount + 1", "l_tax + 0.05", "0.3", "l_discount + 2", "l_tax * 2 + 0.11", "0.4")


@query("gmm_cutoff", """
WITH m AS (SELECT l_orderkey, l_linenumber, l_discount + 1 AS ma, l_tax + 0.05 AS va, CAST(0.3 AS DOUBLE) AS wa, l_discount + 2 AS mb, l_tax * 2 + 0.11 AS vb, CAST(0.4 AS DOUBLE) AS wb FROM lineitem),
k AS (SELECT *, 1 / (2 * va) - 1 / (2 * vb) AS a, mb / vb - ma / va AS b, ma * ma / (2 * va) - mb * mb / (2 * vb) + ln(wb * sqrt(va) / (wa * sqrt(vb))) AS c FROM m),
r AS (SELECT *, b * b - 4 * a * c AS disc FROM k),
s AS (SELECT *, CASE WHEN disc >= 0 THEN (-b + sqrt(disc)) / (2 * a) END AS r1, CASE WHEN disc >= 0 THEN (-b - sqrt(disc)) / (2 * a) END AS r2 FROM r)
SELECT l_orderkey, l_linenumber, round(exp(CASE WHEN abs(a) < 1e-12 THEN -c / greatest(b, 1e-12) WHEN disc < 0 THEN (ma + mb) / 2 WHEN r1 BETWEEN ma AND mb THEN r1 WHEN r2 BETWEEN ma AND mb THEN r2
  WHEN abs(r1 - (ma + mb) / 2) < abs(r2 - (ma + mb) / 2) THEN r1 ELSE r2 END) - 1, 6) AS cutoff FROM s""")
def gmm_cutoff(spark, sf):
    """Crossing point of two weighted Gaussians from given parameters."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(MG.gmm_cutoff(*[F.expr(e).cast("double") for e in GMM]), 6).alias("cutoff"))


# --- regions ----------------------------------------------------------------------


def lines(spark, sf):
    """Two three-point lines per sample; their bend depends on the sample's height."""
    v = vol(spark, sf).withColumn("_l", F.explode(F.array(F.lit(8), F.lit(16)))).withColumn("seq", F.explode(F.expr("sequence(0, 2)")))
    return v.select(
        "fish_id", F.col("_l").alias("line_no"), "seq", (F.col("seq") * F.col("ny") / 2.0 * F.col("sy")).alias("y_um"),
        ((F.col("_l") + F.when(F.col("seq") == 1, 1.5).otherwise(0.0)) * F.col("sx")).alias("x_um"),
    )


LINES = """seg AS (SELECT fish_id, l AS line_no, s AS seq, s * ny / 2.0::DOUBLE * sy AS ay, (l + CASE s WHEN 1 THEN 1.5::DOUBLE ELSE 0 END) * sx AS ax, (s + 1) * ny / 2.0::DOUBLE * sy AS b2y,
  (l + CASE s WHEN 0 THEN 1.5::DOUBLE ELSE 0 END) * sx AS b2x FROM vol, (VALUES (8), (16)) a(l), (VALUES (0), (1)) b(s)),
pp AS (SELECT fish_id, label, cy * sy AS y, cx * sx AS x FROM i JOIN vol USING (fish_id)),
pj AS (SELECT fish_id, label, line_no, seq, y, x, ay, ax, b2y - ay AS dy, b2x - ax AS dx, greatest(0, least(1, ((x - ax) * (b2x - ax) + (y - ay) * (b2y - ay)) / ((b2x - ax) ** 2 + (b2y - ay) ** 2))) AS u FROM pp JOIN seg USING (fish_id)),
sd AS (SELECT *, sqrt((x - (ax + u * dx)) ** 2 + (y - (ay + u * dy)) ** 2) AS dist, CASE WHEN dx * (y - ay) - dy * (x - ax) < 0 THEN -1 ELSE 1 END AS side FROM pj),
ln AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fish_id, label, line_no ORDER BY dist, seq) AS r FROM sd) WHERE r = 1)"""


def line_points(spark, sf):
    o = OB.object_info(blocks(spark, sf)).join(vol(spark, sf).select("fish_id", "sy", "sx"), "fish_id")
    return o.select("fish_id", "label", (F.col("cy") * F.col("sy")).alias("y"), (F.col("cx") * F.col("sx")).alias("x"))


@query("polyline_side_dist", with_(*BI, LINES, body="SELECT fish_id, label, line_no, side, round(dist, 6) AS dist FROM ln"))
def polyline_side_dist(spark, sf):
    return rounded(R.polyline_side_dist(line_points(spark, sf), lines(spark, sf)))


@query("assign_regions", with_(*BI, LINES, body="""
SELECT fish_id, label, CASE count(*) FILTER (side < 0) WHEN 0 THEN 'front' WHEN 1 THEN 'middle' ELSE 'region_2' END AS brain_region, round(min(dist), 6) AS region_boundary_dist_um FROM ln GROUP BY ALL"""))
def assign_regions(spark, sf):
    names = vol(spark, sf).select("fish_id", F.array(F.lit("front"), F.lit("middle")).alias("names"))
    return rounded(R.assign_regions(line_points(spark, sf), lines(spark, sf), names))


@query("stats_columns", with_(*BI, UM, body="""
SELECT fish_id, label, round_even(zu, 2) AS centroid_z_um, round_even(yu, 2) AS centroid_y_um, round_even(xu, 2) AS centroid_x_um, volume_vox FROM um"""))
def stats_columns(spark, sf):
    """Column selection with group expansion."""
    o = SC.to_um(OB.object_info(blocks(spark, sf)), vol(spark, sf))
    return SK.expand_columns(o, ["centroid_um", "volume_vox", "not_there"])


FULL_DIR = """, dr AS (SELECT fish_id, label, greatest(abs((i_yy - l3) * (i_xx - l3) - i_yx ** 2), abs((i_zz - l3) * (i_xx - l3) - i_zx ** 2), abs((i_zz - l3) * (i_yy - l3) - i_zy ** 2)) AS top,
  abs((i_yy - l3) * (i_xx - l3) - i_yx ** 2) AS gz, abs((i_zz - l3) * (i_xx - l3) - i_zx ** 2) AS gy, least(i_zz, i_yy, i_xx) * (1 + 1e-12) AS low, * EXCLUDE (fish_id, label) FROM ax),
dd AS (SELECT *, CASE WHEN top <= t * t * 1e-7 AND i_zz <= low THEN 'Z' WHEN top <= t * t * 1e-7 AND i_yy <= low THEN 'Y' WHEN top <= t * t * 1e-7 THEN 'X'
  WHEN gz >= top * (1 - 1e-6) THEN 'Z' WHEN gy >= top * (1 - 1e-6) THEN 'Y' ELSE 'X' END AS dir FROM dr)"""


@query("stats_table", with_(VOX, VOL, labels_sql("g", 0), info_sql("g", "i"), UM, PTS, LINES.replace("cy * sy AS y, cx * sx AS x", "round_even(cy * sy, 2) AS y, round_even(cx * sx, 2) AS x"), "blk AS (SELECT * FROM g)", PROPS, AXES, body=FULL_DIR + """
, it AS (SELECT g.fish_id, g.label, avg(value) AS mi, sum(value) AS si FROM g JOIN vox USING (fish_id, z, y, x) GROUP BY ALL),
rg AS (SELECT l.fish_id, l.label, count(*) FILTER (side < 0) AS k FROM (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY fish_id, label, line_no ORDER BY dist, seq) AS r FROM sd s) WHERE r = 1) l GROUP BY ALL),
lc AS (SELECT fish_id, label, count(*) AS n FROM d WHERE dist <= 100 GROUP BY ALL)
SELECT u.fish_id, u.label, u.volume_vox, round(round_even(v, 2), 1) AS volume_um3, round_even(zu, 2) AS centroid_z_um, u.z0 AS bbox_z0_vox, u.x1 AS bbox_x1_vox, round(round_even(cbrt(6 * v / pi()), 2), 1) AS eq_diam_um, dir AS principal_axis_dir,
  round(si, 2) AS integrated_intensity, a.nn_label AS nearest_neighbor_label, round_even(a.dist, 2) AS nearest_neighbor_dist_um, lc.n AS local_density_100um,
  CASE k WHEN 0 THEN 'front' WHEN 1 THEN 'middle' ELSE 'back' END AS brain_region
FROM um u JOIN dd USING (fish_id, label) JOIN it USING (fish_id, label) JOIN nn a ON a.fish_id = u.fish_id AND a.label = u.label AND a.rank = 1 JOIN lc ON lc.fish_id = u.fish_id AND lc.label = u.label JOIN rg ON rg.fish_id = u.fish_id AND rg.label = u.label"""))
def stats_table(spark, sf):
    """The statistics job, its SQL-expressible columns."""
    names = vol(spark, sf).select("fish_id", F.array(F.lit("front"), F.lit("middle"), F.lit("back")).alias("names"))
    t = J.compute_stats(truth(spark, sf), vol(spark, sf), SCALE, vox(spark, sf), lines(spark, sf), names)
    return t.select(
        "fish_id", "label", "volume_vox", F.round("volume_um3", 1).alias("volume_um3"), "centroid_z_um", "bbox_z0_vox", "bbox_x1_vox",
        F.round("eq_diam_um", 1).alias("eq_diam_um"), "principal_axis_dir", F.round("integrated_intensity", 2).alias("integrated_intensity"),
        "nearest_neighbor_label", "nearest_neighbor_dist_um", "local_density_100um",
        "brain_region",
    )
