"""Queries: scans, components and label-set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as CC, labels as L, objects as OB
from ..schemas import ZYX
from .base import (
    VOL, VOX, blocks, blocks_sql, cc_sql, found, labels_sql, occ_sql, occupied, predicted, query, rounded, table, truth, vol, vox, with_,
)
from ..sources import volumes as SV


def summary(df, *extra):
    """Per-sample checks of a voxel table: count and coordinate sums."""
    aggs = [F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(f"sum_{c}") for c in (*ZYX, *extra)]]
    return df.groupBy("fish_id").agg(*aggs)


@query("flagship_cells", with_(VOX, occ_sql("o", 20), cc_sql("o", "c"), body="""
, s AS (SELECT fish_id, component, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 5),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY fish_id ORDER BY n DESC, component DESC) AS INT) AS label FROM s)
SELECT fish_id, label, count(*) AS volume_vox, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx,
  min(z) AS z0, min(y) AS y0, min(x) AS x0, max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1
FROM c JOIN k USING (fish_id, component) GROUP BY fish_id, label""".strip()))
def flagship_cells(spark, sf):
    """Voxels -> threshold -> 26-components -> size filter -> numbering by volume -> object table."""
    labels = L.label_mask(occupied(spark, sf, 20.0), 8)
    return rounded(OB.object_info(labels))


@query("scan_voxels", with_(VOX, VOL, body="""
SELECT v.fish_id, v.channel, v.z, count(*) AS n, round(sum(value), 4) AS total, round(max(sz * sy * sx), 8) AS voxel_um3
FROM vox v JOIN vol USING (fish_id) GROUP BY ALL"""))
def scan_voxels(spark, sf):
    v = vox(spark, sf).join(vol(spark, sf).drop("channel"), "fish_id")
    return v.groupBy("fish_id", "channel", "z").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max(F.col("sz") * F.col("sy") * F.col("sx")), 8).alias("voxel_um3")
    )


@query("channel_split", """
WITH v AS (SELECT l_returnflag AS fish_id, CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS channel, count(*) AS n_rows FROM lineitem GROUP BY ALL),
c AS (SELECT fish_id, count(DISTINCT channel) AS k FROM v GROUP BY ALL)
SELECT fish_id, channel, n_rows, CASE WHEN k > 1 THEN fish_id || '_ch' || channel ELSE fish_id END AS layer FROM v JOIN c USING (fish_id)""")
def channel_split(spark, sf):
    li = table(spark, sf, "lineitem")
    v = li.groupBy(
        F.col("l_returnflag").alias("fish_id"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("channel")
    ).agg(F.count("*").alias("n_rows"))
    return SV.channel_names(v).select("fish_id", "channel", "n_rows", "layer")


@query("select_channel", """
SELECT l_returnflag AS fish_id, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL""")
def select_channel(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("fish_id"), (F.col("l_linestatus") == "O").cast("int").alias("channel"))
    return SV.select_channel(li, 1).groupBy("fish_id").agg(F.count("*").alias("n"))


@query("encode_runs", with_(VOX, occ_sql("o", 0), body="""
, i AS (SELECT *, x - row_number() OVER (PARTITION BY fish_id, z, y ORDER BY x) AS g FROM o)
SELECT fish_id, z, y, min(x) AS x0, max(x) AS x1 FROM i GROUP BY fish_id, z, y, g""".strip()))
def encode_runs(spark, sf):
    return CC.encode_runs(occupied(spark, sf, 0.0))


for _conn, _cut in ((26, 0), (6, 0), (26, 20), (8, 0), (4, 0)):

    @query(f"components_{_conn}_cut{_cut}", with_(VOX, occ_sql("o", _cut), cc_sql("o", "c", _conn), body="""
SELECT fish_id, component, count(*) AS n, CAST(sum(z) AS BIGINT) AS sz, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x) AS BIGINT) AS sx FROM c GROUP BY fish_id, component"""))
    def _components(spark, sf, conn=_conn, cut=_cut):
        """Connected components in 3-D (6, 26) and per slice (4, 8)."""
        return found(spark, sf, float(cut), conn).groupBy("fish_id", "component").agg(
            F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(f"s{c}") for c in ZYX]
        )


@query("components_small_bricks", with_(VOX, occ_sql("o", 0), cc_sql("o", "c"), body="""
SELECT fish_id, component, count(*) AS n FROM c GROUP BY fish_id, component"""))
def components_small_bricks(spark, sf):
    """The same labelling cut into small bricks, so that pieces must be joined across faces."""
    out = CC.components(occupied(spark, sf, 0.0), brick=(8, 8, 8))
    return out.groupBy("fish_id", "component").agg(F.count("*").alias("n"))


@query("label_components", with_(VOX, labels_sql("g", 0), body="""
SELECT fish_id, label, count(*) AS n, CAST(sum(z) AS BIGINT) AS sz FROM g GROUP BY fish_id, label"""))
def label_components(spark, sf):
    return truth(spark, sf).groupBy("fish_id", "label").agg(F.count("*").alias("n"), F.sum(F.col("z").cast("long")).alias("sz"))


@query("largest_component", with_(VOX, occ_sql("o", 0), cc_sql("o", "c", 6), body="""
, s AS (SELECT fish_id, component, count(*) AS n FROM c GROUP BY ALL),
b AS (SELECT fish_id, component FROM (SELECT *, row_number() OVER (PARTITION BY fish_id ORDER BY n DESC, component) AS r FROM s) WHERE r = 1)
SELECT fish_id, z, y, x FROM c JOIN b USING (fish_id, component)""".strip()))
def largest_component(spark, sf):
    return CC.largest_component(found(spark, sf, 0.0, 6)).select("fish_id", *ZYX)


@query("filter_small", with_(VOX, labels_sql("p", 20), body="""
, s AS (SELECT fish_id, label FROM p GROUP BY ALL HAVING count(*) >= 6)
SELECT fish_id, label, z, y, x FROM p JOIN s USING (fish_id, label)""".strip()))
def filter_small(spark, sf):
    """Size floor max(1, round(0.618 * 10)) = 6."""
    return L.filter_small(predicted(spark, sf), 10).select("fish_id", "label", *ZYX)


@query("final_min_size", with_(VOX, labels_sql("p", 20), body="""
, s AS (SELECT fish_id, label, count(*) AS n FROM p GROUP BY ALL)
SELECT fish_id, CAST(count(*) FILTER (n < 5) AS BIGINT) AS n_removed, CAST(coalesce(sum(n) FILTER (n >= 5), 0) AS BIGINT) AS voxels_left FROM s GROUP BY fish_id""".strip()))
def final_min_size(spark, sf):
    kept, removed = L.final_min_size(predicted(spark, sf), 8)
    left = kept.groupBy("fish_id").agg(F.count("*").alias("voxels_left"))
    return removed.join(left, "fish_id", "left").na.fill(0, ["voxels_left"]).select("fish_id", "n_removed", "voxels_left")


@query("remove_debris", with_(VOX, blocks_sql(), cc_sql("blk", "c", 26, "fish_id, label"), body="""
, s AS (SELECT fish_id, label, component, count(*) AS n FROM c GROUP BY ALL),
r AS (SELECT fish_id, CAST(count(*) FILTER (n < 4) AS BIGINT) AS n_removed FROM s GROUP BY fish_id),
k AS (SELECT fish_id, label, sum(n) AS n FROM s WHERE n >= 4 GROUP BY ALL)
SELECT fish_id, label, CAST(n AS BIGINT) AS n, n_removed FROM k JOIN r USING (fish_id)""".strip()))
def remove_debris(spark, sf):
    """Pieces under 4 voxels are dropped from each label; ids stay."""
    kept, removed = L.remove_debris(blocks(spark, sf), 4)
    return kept.groupBy("fish_id", "label").agg(F.count("*").alias("n")).join(removed, "fish_id")


@query("relabel_by_volume", with_(VOX, labels_sql("p", 20), body="""
, s AS (SELECT fish_id, label, count(*) AS n FROM p GROUP BY ALL)
SELECT fish_id, label AS old_label, n, CAST(row_number() OVER (PARTITION BY fish_id ORDER BY n DESC, label DESC) AS INT) AS label FROM s""".strip()))
def relabel_by_volume(spark, sf):
    p = predicted(spark, sf)
    new = L.relabel_by_volume(p)
    both = p.withColumnRenamed("label", "old_label").join(new, ["fish_id", *ZYX])
    return both.groupBy("fish_id", "old_label", "label").agg(F.count("*").alias("n"))


@query("relabel_sequential", with_(VOX, blocks_sql(), body="""
SELECT fish_id, label AS old_label, count(*) AS n, CAST(dense_rank() OVER (PARTITION BY fish_id ORDER BY label) AS INT) AS label FROM blk WHERE label % 3 <> 0 GROUP BY fish_id, label"""))
def relabel_sequential(spark, sf):
    b = blocks(spark, sf).filter("label % 3 <> 0")
    both = b.withColumnRenamed("label", "old_label").join(L.relabel_sequential(b), ["fish_id", *ZYX])
    return both.groupBy("fish_id", "old_label", "label").agg(F.count("*").alias("n"))


for _by, _rev, _key in (
    ("size", False, "count(*) DESC"), ("size", True, "count(*)"), ("centroid_z", False, "avg(z)"), ("centroid_x", True, "avg(x) DESC"),
    ("centroid_y", False, "avg(y)"),
):

    @query(f"resort_{_by}{'_reverse' if _rev else ''}", with_(VOX, blocks_sql(), body=f"""
SELECT fish_id, label AS old_label, CAST(row_number() OVER (PARTITION BY fish_id ORDER BY {_key}, label) AS INT) AS label FROM blk GROUP BY fish_id, label"""))
    def _resort(spark, sf, by=_by, rev=_rev):
        b = blocks(spark, sf)
        both = b.withColumnRenamed("label", "old_label").join(L.resort_labels(b, by, rev), ["fish_id", *ZYX])
        return both.select("fish_id", "old_label", "label").distinct()


@query("join_labels", with_(VOX, blocks_sql(), body="""
SELECT fish_id, CASE WHEN label % 2 = 0 THEN label - 1 ELSE label END AS label, count(*) AS n FROM blk GROUP BY 1, 2"""))
def join_labels(spark, sf):
    """Even labels are merged into the odd label before them (absent targets allowed)."""
    b = blocks(spark, sf)
    req = b.filter("label % 2 = 0").select("fish_id", F.col("label").alias("label_b"), (F.col("label") - 1).alias("label_a")).distinct()
    return L.join_labels(b, req, check=False).groupBy("fish_id", "label").agg(F.count("*").alias("n"))


@query("apply_lut", with_(VOX, blocks_sql(), body="""
SELECT fish_id, label * 10 AS label, count(*) AS n FROM blk WHERE label % 4 <> 1 GROUP BY 1, 2"""))
def apply_lut(spark, sf):
    b = blocks(spark, sf)
    lut = b.filter("label % 4 <> 1").select("fish_id", "label", (F.col("label") * 10).alias("new_label")).distinct()
    return L.apply_lut(b, lut).groupBy("fish_id", "label").agg(F.count("*").alias("n"))


@query("splice", with_(VOX, blocks_sql(), labels_sql("g", 0), body="""
, req AS (SELECT fish_id, min(label) AS label FROM blk GROUP BY ALL),
foot AS (SELECT fish_id, z, y, x FROM blk JOIN req USING (fish_id, label)),
rest AS (SELECT b.* FROM blk b JOIN req r USING (fish_id) WHERE b.label <> r.label),
hit AS (SELECT DISTINCT fish_id, label FROM g JOIN foot USING (fish_id, z, y, x)),
ids AS (SELECT h.fish_id, h.label, (SELECT max(label) FROM rest r WHERE r.fish_id = h.fish_id) + row_number() OVER (PARTITION BY h.fish_id ORDER BY h.label) AS new_label FROM hit h),
added AS (SELECT g.fish_id, z, y, x, new_label AS label FROM g JOIN ids USING (fish_id, label)),
outp AS (SELECT fish_id, z, y, x, label FROM rest r WHERE NOT EXISTS (SELECT 1 FROM added a WHERE a.fish_id = r.fish_id AND a.z = r.z AND a.y = r.y AND a.x = r.x) UNION ALL SELECT * FROM added)
SELECT fish_id, CAST(label AS INT) AS label, count(*) AS n FROM outp GROUP BY 1, 2""".strip()))
def splice(spark, sf):
    """The lowest block label of each sample is replaced by the components touching it."""
    b = blocks(spark, sf)
    req = b.groupBy("fish_id").agg(F.min("label").alias("label"))
    return L.splice(b, truth(spark, sf), req).groupBy("fish_id", "label").agg(F.count("*").alias("n"))


@query("overlap_link", with_(VOX, occ_sql("o", 0), cc_sql("o", "c", 8, "fish_id, z"), body="""
, px AS (SELECT fish_id, z, y, x, component AS node FROM c),
a AS (SELECT fish_id, node, count(*) AS n FROM px GROUP BY ALL),
l AS (SELECT p.fish_id, q.node AS a, p.node AS b FROM px p JOIN px q ON q.fish_id = p.fish_id AND q.z = p.z - 1 AND q.y = p.y AND q.x = p.x
      JOIN a na ON na.fish_id = q.fish_id AND na.node = q.node JOIN a nb ON nb.fish_id = p.fish_id AND nb.node = p.node
      GROUP BY p.fish_id, q.node, p.node HAVING count(*) * 1.0 / least(min(na.n), min(nb.n)) >= 0.5),
e AS (SELECT * FROM l UNION SELECT fish_id, b, a FROM l),
r(fish_id, node, root) AS (SELECT fish_id, node, node FROM a UNION SELECT r.fish_id, e.b, r.root FROM r JOIN e ON e.fish_id = r.fish_id AND e.a = r.node WHERE e.b > r.root),
m AS (SELECT fish_id, node, min(root) AS root FROM r GROUP BY ALL)
SELECT fish_id, root % 4398046511104 + (root // 4398046511104) * 4398046511104 AS first_voxel, count(*) AS n_slices FROM m GROUP BY ALL""".strip()))
def overlap_link(spark, sf):
    """Per-slice objects linked between slices when they share at least half of the smaller one."""
    flat = CC.components(occupied(spark, sf, 0.0), conn=8)
    px = flat.select("fish_id", *ZYX, F.expr("CAST(component % 4398046511104 AS LONG)").alias("label"))
    objs = CC.overlap_link(px.withColumn("label", F.col("label").cast("long")), 0.5)
    first = (F.col("group.z") * 4398046511104 + F.col("group.label")).alias("first_voxel")
    return objs.groupBy("fish_id", first).agg(F.count("*").alias("n_slices"))
