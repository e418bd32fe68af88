"""Queries: sweeps, calibration history, logs, listings, sinks, streams and composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sweeps as SW
from ..operators.masks import apply_mask
from ..plans import jobs as J
from ..plans.tiles import tile_score
from ..schemas import ZYX
from ..session import materialize, scratch_path
from ..sources import listing as LS, metric_log as ML, sinks as SK, volumes as SV
from ..streaming import metrics as ST
from .masking import holes_sql
from .base import (
    BRAIN, PROBS, SCALE, VOL, VOX, blocks, blocks_sql, brain, cc_sql, labels_sql, occupied, predicted, probs, query, rounded, table, truth, vol, vox, with_,
)

# Widths at which a site needs neighbours to stay: narrower ones (0.5 with 0.3) give every mask back, wider ones empty these.
SIGMAS_XY, SIGMAS_Z = (0.5, 0.6), (0.5,)

GT = "gt AS (SELECT fish_id, z, y, x FROM vox WHERE value > 30)"
CUTS = (0.1, 0.3, 0.4, 0.45, 0.5)


def gt_mask(spark, sf):
    return occupied(spark, sf, 30.0)


VS = f"""vs AS (SELECT p.fish_id, c.c AS p1, count(*) AS pred_vox, count(g.z) AS tp FROM probs p JOIN (VALUES {", ".join(f"(CAST({c} AS DOUBLE))" for c in CUTS)}) c(c) ON p.p > c.c
  LEFT JOIN gt g ON g.fish_id = p.fish_id AND g.z = p.z AND g.y = p.y AND g.x = p.x GROUP BY ALL),
gv AS (SELECT fish_id, count(*) AS gt_vox FROM gt GROUP BY ALL),
sc AS (SELECT fish_id, p1, pred_vox, gt_vox, tp, 200.0::DOUBLE * tp / (pred_vox + gt_vox) AS dice, 100.0::DOUBLE * tp / (pred_vox + gt_vox - tp) AS iou FROM vs JOIN gv USING (fish_id))"""


@query("voxel_sweep", with_(VOX, PROBS, GT, VS, body="SELECT fish_id, p1, pred_vox, gt_vox, tp, round(dice, 6) AS dice, round(iou, 6) AS iou FROM sc"))
def voxel_sweep(spark, sf):
    """Five cut-offs scored in one pass."""
    return rounded(J.voxel_sweep(probs(spark, sf), gt_mask(spark, sf), CUTS)[0].drop("p2"))


@query("voxel_sweep_best", with_(VOX, PROBS, GT, VS, body="""
SELECT fish_id, p1, round(dice, 6) AS dice FROM (SELECT *, row_number() OVER (PARTITION BY fish_id ORDER BY dice DESC, p1) AS r FROM sc) WHERE r = 1"""))
def voxel_sweep_best(spark, sf):
    return rounded(J.voxel_sweep(probs(spark, sf), gt_mask(spark, sf), CUTS)[1].select("fish_id", "p1", "dice"))


def _mask_sql() -> str:
    return """p8 AS (SELECT fish_id, t AS p1, z, y, x FROM probs JOIN (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) c(t) ON p > t),
""" + cc_sql("p8", "c", 6, "fish_id, p1") + """,
s AS (SELECT fish_id, p1, component, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fish_id, p1 ORDER BY n DESC, component) AS r FROM s) WHERE r = 1),
m AS (SELECT fish_id, p1, z, y, x FROM c JOIN b USING (fish_id, p1, component)),
hp AS (SELECT DISTINCT a.fish_id, a.p1, a.z, a.y, CAST(a.x + 1 AS INT) AS x FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.fish_id = a.fish_id AND b.p1 = a.p1 AND b.z = a.z AND b.y = a.y AND b.x = a.x + 1)
  AND (SELECT count(*) FROM m b WHERE b.fish_id = a.fish_id AND b.p1 = a.p1 AND abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x - 1) = 1) = 6),
f AS (SELECT * FROM m UNION ALL SELECT * FROM hp),
e1 AS (SELECT a.fish_id, a.p1, a.z, a.y, a.x FROM f a JOIN f b ON b.fish_id = a.fish_id AND b.p1 = a.p1 AND abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x) <= 1 GROUP BY ALL HAVING count(*) = 7),
ev AS (SELECT *, CAST(0 AS DOUBLE) AS p2 FROM f UNION ALL SELECT *, 1 FROM e1),
st AS (SELECT e.fish_id, p1, p2, count(*) AS pv, count(g.z) AS tp FROM ev e LEFT JOIN gt g USING (fish_id, z, y, x) GROUP BY ALL),
al AS (SELECT fish_id, p1, p2, gt_vox, coalesce(pv, 0) AS pred_vox, coalesce(tp, 0) AS tp FROM (SELECT fish_id, count(*) AS gt_vox FROM gt GROUP BY ALL) g
  JOIN (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) a(p1) ON true JOIN (VALUES (CAST(0 AS DOUBLE)), (CAST(1 AS DOUBLE))) b(p2) ON true LEFT JOIN st USING (fish_id, p1, p2))"""


@query("mask_sweep", with_(VOX, PROBS, GT, _mask_sql(), body="SELECT fish_id, p1, p2, pred_vox, gt_vox, round(200.0::DOUBLE * tp / (pred_vox + gt_vox), 6) AS dice FROM al"))
def mask_sweep(spark, sf):
    """Threshold x erosion; both thresholds post-processed in one job (single-site holes only on this data)."""
    r, _ = J.mask_sweep(probs(spark, sf), gt_mask(spark, sf), vol(spark, sf), [0.05, 0.2], [0, 1])
    return rounded(r.select("fish_id", "p1", "p2", "pred_vox", "gt_vox", "dice"))


# Sweep results as a long table from real rows: cell = order line number, grid from part and supplier.
RESULTS = """rs AS (SELECT l_returnflag AS fish_id, l_linenumber AS label, CAST(l_partkey % 4 AS DOUBLE) AS p1, CAST(l_suppkey % 3 AS DOUBLE) AS p2,
  round(avg(l_discount) * 1000, 4) AS iou, round(avg(l_tax) * 1000, 4) AS dice, count(*) AS tp FROM lineitem GROUP BY ALL)"""


def results(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        F.col("l_returnflag").alias("fish_id"), F.col("l_linenumber").alias("label"), (F.col("l_partkey") % 4).cast("double").alias("p1"),
        (F.col("l_suppkey") % 3).cast("double").alias("p2"),
    ).agg(F.round(F.avg("l_discount") * 1000, 4).alias("iou"), F.round(F.avg("l_tax") * 1000, 4).alias("dice"), F.count("*").alias("tp"))


@query("sweep_avg", f"WITH {RESULTS} SELECT fish_id, p1, p2, round(avg(iou), 4) AS iou, round(avg(dice), 4) AS dice, count(*) AS n_scored FROM rs GROUP BY ALL HAVING count(*) = 7")
def sweep_avg(spark, sf):
    a = SW.sweep_avg(results(spark, sf), 7)
    return a.withColumns({c: F.round(c, 4) for c in ("iou", "dice")})


@query("best_point", f"""WITH {RESULTS}, a AS (SELECT fish_id, p1, p2, round(avg(iou), 3) AS iou, round(avg(dice), 3) AS dice FROM rs GROUP BY ALL)
SELECT fish_id, p1, p2, iou, dice FROM (SELECT *, row_number() OVER (PARTITION BY fish_id ORDER BY iou DESC, dice DESC, p1, p2) AS r FROM a) WHERE r = 1""")
def best_point(spark, sf):
    a = SW.sweep_avg(results(spark, sf)).withColumns({c: F.round(c, 3) for c in ("iou", "dice")}).drop("n_scored")
    return SW.best_point(a, ["iou", "dice"])


@query("best_point_needs_tp", f"""WITH {RESULTS}, a AS (SELECT fish_id, p1, p2, label AS score, CASE WHEN label >= 6 THEN 0 ELSE tp END AS tp FROM rs)
SELECT fish_id, p1, p2, score FROM (SELECT *, row_number() OVER (PARTITION BY fish_id ORDER BY tp > 0 DESC, score DESC, p1, p2) AS r FROM a) WHERE r = 1""")
def best_point_needs_tp(spark, sf):
    a = results(spark, sf).select("fish_id", "p1", "p2", F.col("label").alias("score"), F.when(F.col("label") >= 6, 0).otherwise(F.col("tp")).alias("tp"))
    return SW.best_point(a, ["score"], needs_tp=True).drop("tp")


@query("winner_per_cell", f"""WITH {RESULTS} SELECT fish_id, label, p1, p2, iou FROM (SELECT *, row_number() OVER (PARTITION BY fish_id, label ORDER BY iou DESC, p1, p2) AS r FROM rs) WHERE r = 1""")
def winner_per_cell(spark, sf):
    return SW.winner_per_cell(results(spark, sf))


@query("cross_grid", """SELECT l_returnflag AS fish_id, a.v AS p1, b.v AS p2, count(*) FILTER (l_discount > a.v AND l_tax > b.v) AS n FROM lineitem,
 (VALUES (CAST(0 AS DOUBLE)), (CAST(0.025 AS DOUBLE)), (CAST(0.05 AS DOUBLE))) a(v), (VALUES (CAST(0 AS DOUBLE)), (CAST(0.03 AS DOUBLE))) b(v) GROUP BY ALL""")
def cross_grid(spark, sf):
    """Every row under a swept grid: values 0, 0.025, 0.05 by 0 and 0.03."""
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("fish_id"), "l_discount", "l_tax")
    pts = [(a, b) for a in SW.sweep_values(0.0, 0.05, 0.025) for b in (0.0, 0.03)]
    return SW.cross_grid(li, pts).groupBy("fish_id", "p1", "p2").agg(
        F.sum(((F.col("l_discount") > F.col("p1")) & (F.col("l_tax") > F.col("p2"))).cast("long")).alias("n")
    )


@query("grid_report", f"WITH {RESULTS} SELECT fish_id, label, p2, " + ", ".join(f"round_even(max(iou) FILTER (p1 = {v}), 1) AS p1_{v}" for v in range(4)) + " FROM rs GROUP BY ALL")
def grid_report(spark, sf):
    return SW.grid_report(results(spark, sf), "iou", [0, 1, 2, 3], ["fish_id", "label"])


@query("grid_lines", f"""WITH {RESULTS}, a AS (SELECT *, row_number() OVER (PARTITION BY fish_id, label ORDER BY iou DESC, p1, p2) AS r FROM (SELECT fish_id, label, p1, p2, CAST(tp AS DOUBLE) AS iou FROM rs))
SELECT fish_id, label, p1, p2, printf('%8.2f %8.2f %7.1f', p1, p2, iou) || CASE WHEN r = 1 THEN '  <- best' ELSE '' END AS line FROM a""")
def grid_lines(spark, sf):
    r = results(spark, sf).select("fish_id", "label", "p1", "p2", F.col("tp").cast("double").alias("iou"))
    return SW.grid_lines(r, "iou", ["fish_id", "label"])


def _stage_sql(i: int, width: float, step: float) -> str:
    lo, hi = f"greatest(0.0, (SELECT b FROM b{i - 1}) - {width})", f"least(0.8, (SELECT b FROM b{i - 1}) + {width})"
    grid = f"SELECT round({lo} + k * {step}::DOUBLE, 4) AS p1 FROM range(0, 100) t(k) WHERE {lo} + k * {step}::DOUBLE < {hi} + {step} / 2"
    return _scores_sql(i, grid)


def _scores_sql(i: int, grid: str) -> str:
    return f"""g{i} AS ({grid}),
s{i} AS (SELECT p1, avg(d) AS dice FROM (SELECT n.p1, n.fish_id, 200.0::DOUBLE * coalesce(tp, 0) / (coalesce(pv, 0) + gt_vox) AS d FROM (SELECT p1, fish_id, gt_vox FROM g{i}, gv) n
  LEFT JOIN (SELECT g.p1, p.fish_id, count(*) AS pv, count(t.z) AS tp FROM g{i} g JOIN probs p ON p.p > g.p1 LEFT JOIN gt t ON t.fish_id = p.fish_id AND t.z = p.z AND t.y = p.y AND t.x = p.x GROUP BY ALL) q USING (p1, fish_id)) GROUP BY ALL),
b{i} AS (SELECT p1 AS b FROM s{i} ORDER BY dice DESC, p1 LIMIT 1)"""


@query("sieve", with_(VOX, PROBS, GT, "gv AS (SELECT fish_id, count(*) AS gt_vox FROM gt GROUP BY ALL)", _scores_sql(1, "SELECT round(k * 0.2::DOUBLE, 4) AS p1 FROM range(0, 5) t(k)"),
  _stage_sql(2, 0.2, 0.05), _stage_sql(3, 0.05, 0.01), body=" UNION ALL ".join(f"SELECT p1, round(dice, 6) AS dice, {i} AS stage, p1 = (SELECT b FROM b{i}) AS is_best FROM s{i}" for i in (1, 2, 3))))
def sieve(spark, sf):
    """Coarse-to-fine probability cut-off by mean Dice; each stage is one job over the whole map."""
    p, g = materialize(probs(spark, sf)), materialize(gt_mask(spark, sf))

    def score(values):
        cells, _ = J.voxel_sweep(p, g, values)
        return cells.groupBy(F.col("p1").alias("value")).agg(F.avg("dice").alias("score"))

    out = SW.sieve(score, 0.0, 0.8, [SW.Stage(0.2), SW.Stage(0.05, 0.2), SW.Stage(0.01, 0.05)])
    out = out.select(F.col("value").alias("p1"), F.col("score").alias("dice"), "stage", "is_best")
    return rounded(out)


HIST = """hi AS (SELECT CASE event_type WHEN 'click' THEN 'min_volume_vox' WHEN 'view' THEN 'max_volume_vox' WHEN 'error' THEN 'erosion_voxels' ELSE 'sigma_xy' END AS config_key,
  'u' || user_id AS fish_id, value, value > 10 AS verified, ts FROM events),
lt AS (SELECT config_key, fish_id, arg_max(value, ts) AS value FROM hi WHERE verified GROUP BY ALL)"""


def history(spark, sf):
    e = table(spark, sf, "events")
    key = F.when(F.col("event_type") == "click", "min_volume_vox").when(F.col("event_type") == "view", "max_volume_vox").when(
        F.col("event_type") == "error", "erosion_voxels").otherwise("sigma_xy")
    return e.select(key.alias("config_key"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fish_id"), "value",
                    (F.col("value") > 10).alias("verified"), "ts")


for _m, _f in (("min", "min"), ("max", "max"), ("mean", "avg")):

    @query(f"recommend_{_m}", f"WITH {HIST} SELECT config_key, round({_f}(value), 6) AS value, count(*) AS n_samples FROM lt GROUP BY ALL")
    def _recommend(spark, sf, m=_m):
        return rounded(SW.recommend(history(spark, sf), m))


@query("recommend_all", f"""WITH {HIST} SELECT config_key, CASE config_key WHEN 'min_volume_vox' THEN 'min' WHEN 'max_volume_vox' THEN 'max' ELSE 'mean' END AS mode,
 round(CASE config_key WHEN 'min_volume_vox' THEN min(value) WHEN 'max_volume_vox' THEN max(value) WHEN 'erosion_voxels' THEN round_even(avg(value), 0) ELSE avg(value) END, 6) AS value, count(*) AS n_samples FROM lt GROUP BY config_key""")
def recommend_all(spark, sf):
    return rounded(SW.recommend_all(history(spark, sf)))


@query("calibrate", with_(VOX, VOL, labels_sql("g", 0), "gl AS (SELECT fish_id || '/' || label AS fish_id, z, y, x FROM g)", holes_sql("gl", "h"), body="""
, s AS (SELECT fish_id, label, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT fish_id, min(n) AS lo, max(n) AS hi FROM s GROUP BY ALL)
SELECT 'max_volume_vox' AS config_key, 'max' AS mode, CAST(max(hi) AS DOUBLE) AS value, count(*) AS n_samples FROM m WHERE fish_id <> 'error'
UNION ALL SELECT 'min_volume_vox', 'min', CAST(min(lo) AS DOUBLE), count(*) FROM m WHERE fish_id <> 'error'
UNION ALL SELECT 'min_hole_size_vox', 'min', CAST(min(coalesce(k.n, 20)) AS DOUBLE), count(*) FROM m LEFT JOIN (
  SELECT split_part(fish_id, '/', 1) AS fish_id, min(hole_size) AS n FROM h WHERE hole_size >= 5 GROUP BY 1) k USING (fish_id) WHERE fish_id <> 'error'""".strip()))
def calibrate(spark, sf):
    """Size bounds and smallest holes measured on every sample and pooled over the verified ones."""
    g = truth(spark, sf)
    ok = g.select("fish_id").distinct().withColumn("verified", F.col("fish_id") != "error")
    return J.calibrate(g, ok, F.lit("2024-02-01").cast("timestamp"))


# --- logs --------------------------------------------------------------------------------

LOG = """lg AS (SELECT event_type AS run_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, value FROM events)"""


def log_lines(spark, sf):
    """One log line per event: its number in the run and its value."""
    from ..numbering import number_rows

    e = table(spark, sf, "events").select(F.col("event_type").alias("run_id"), "ts", "event_id", "value")
    e = number_rows(e, ["run_id"], [F.col("ts"), F.col("event_id")], "seq").withColumn("seq", F.col("seq").cast("long"))
    return e.select("run_id", "ts", "seq", F.concat(F.col("seq").cast("string"), F.lit(", train_loss=0.5, test_loss="), F.format_string("%.2f", "value")).alias("line"))


@query("metric_log", f"WITH {LOG} SELECT run_id, seq, CAST(seq AS INT) AS epoch, value FROM lg")
def metric_log(spark, sf):
    return ML.parse_lines(log_lines(spark, sf))


@query("metric_log_text", """SELECT 'o' || o_custkey AS run_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS epochs, round(sum(round(o_totalprice / 1000, 0)), 2) AS total FROM orders GROUP BY ALL""")
def metric_log_text(spark, sf):
    """Two-line records: one log text per customer, one record per order (orders per customer are few)."""
    o = table(spark, sf, "orders")
    rec = F.format_string("Epoch %d Summary:\n  lr 0.1\n  Full-brain Dice: %.0f [MODEL SELECTION]\n", F.col("o_orderkey"), F.round(F.col("o_totalprice") / 1000, 0))
    texts = o.groupBy(F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("run_id")).agg(F.array_join(F.collect_list(rec), "").alias("value"))
    m = ML.parse_text(texts, "two_line")
    return m.groupBy("run_id").agg(F.count("*").alias("n"), F.sum(F.col("epoch").cast("long")).alias("epochs"), F.round(F.sum("value"), 2).alias("total"))


for _hi in (True, False):
    _ord = "DESC" if _hi else "ASC"

    @query(f"patience_{'max' if _hi else 'min'}", f"""WITH {LOG}, b AS (SELECT run_id, value AS best_value, seq AS best_seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value {_ord}, seq) AS r FROM lg) WHERE r = 1)
SELECT run_id, count(*) AS n_checkpoints, min(best_value) AS best_value, CAST(min(best_seq) AS INT) AS best_epoch, count(*) FILTER (seq > best_seq) AS checkpoints_since_best,
 count(*) FILTER (seq > best_seq) >= 500 AS exceeded FROM lg JOIN b USING (run_id) GROUP BY ALL""")
    def _patience(spark, sf, hi=_hi):
        return SW.patience(ML.parse_lines(log_lines(spark, sf)), 500, hi)


@query("running_best", f"WITH {LOG} SELECT run_id, seq, max(value) OVER (PARTITION BY run_id ORDER BY seq) AS best_so_far FROM lg")
def running_best(spark, sf):
    return SW.running_best(ML.parse_lines(log_lines(spark, sf)), True, block=256).select("run_id", "seq", "best_so_far")


@query("pick_epochs", "SELECT DISTINCT CAST(l_partkey AS INT) AS epoch FROM lineitem WHERE l_partkey IN (30, 40, 50, 60, 70)")
def pick_epochs(spark, sf):
    return SW.pick_epochs(table(spark, sf, "lineitem").select(F.col("l_partkey").cast("int").alias("epoch")), 50, 10, check=False)


@query("resolve_pointers", """SELECT o_orderpriority AS model, printf('%s_epoch_%04d', o_orderpriority, CAST(max(o_orderkey) % 10000 AS INT)) AS target FROM orders GROUP BY 1
HAVING max(o_orderkey) % 10000 IN (SELECT l_orderkey FROM lineitem)""")
def resolve_pointers(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg((F.max("o_orderkey") % 10000).cast("int").alias("epoch"))
    p = o.select("model", F.format_string("%s_epoch_%04d", "model", "epoch").alias("target"))
    models = F.array(*[F.lit(m) for m in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    ck = table(spark, sf, "lineitem").select("l_orderkey").distinct().select("l_orderkey", F.explode(models).alias("model"))
    return SV.resolve_pointers(p, ck.select(F.format_string("%s_epoch_%04d", "model", "l_orderkey").alias("name"))).select("model", "target")


# --- listings and metadata ---------------------------------------------------------------------


def listing(spark, sf):
    """Artefact files of one folder per order; which ones exist depends on its lines."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("o"), "l_linenumber", (F.col("l_suppkey") % 4).alias("q"))
    keys = list(LS.SUFFIXES.values())
    ending = F.array(*[F.lit(s) for s in keys])[F.col("l_linenumber") - 1]
    stem = F.when(F.col("q") == 0, F.concat(F.lit("copy_"), F.col("o"))).otherwise(F.col("o"))
    return li.select(F.concat(F.lit("/data/"), F.col("o")).alias("folder"), F.concat(stem, ending).alias("name")).withColumn(
        "path", F.concat("folder", F.lit("/"), "name")).distinct()


FILES = "sx(i, k, s) AS (VALUES " + ", ".join(f"({i}, '{k}', '{s}')" for i, (k, s) in enumerate(LS.SUFFIXES.items(), 1)) + """),
fl AS (SELECT DISTINCT '/data/' || l_orderkey AS folder, CASE WHEN l_suppkey % 4 = 0 THEN 'copy_' ELSE '' END || l_orderkey || s AS name, l_orderkey AS o FROM lineitem JOIN sx ON i = l_linenumber),
fd AS (SELECT folder, k, coalesce(max(folder || '/' || name) FILTER (name = o || s), CASE WHEN count(*) = 1 THEN min(folder || '/' || name) END) AS p FROM fl JOIN sx ON ends_with(name, s) GROUP BY ALL),
fw AS (SELECT f.folder, f.o, """ + ", ".join(f"max(p) FILTER (k = '{k}') AS {k}" for k in LS.SUFFIXES) + """ FROM (SELECT DISTINCT folder, o FROM fl) f LEFT JOIN fd USING (folder) GROUP BY ALL)"""


@query("discover_files", f"WITH {FILES} SELECT folder, CAST(o AS VARCHAR) AS stem, {', '.join(LS.SUFFIXES)} FROM fw")
def discover_files(spark, sf):
    return LS.discover_files(listing(spark, sf))


@query("step_preconditions", f"""WITH {FILES}, b AS (SELECT folder, original IS NOT NULL AS o, brain_mask IS NOT NULL AS m, ext_rm IS NOT NULL AS e, no_bg IS NOT NULL AS nb, ground_truth IS NOT NULL AS g FROM fw)
SELECT folder, s AS step, CASE s WHEN 'monai' THEN o AND m WHEN 'bg' THEN (o OR e) AND m AND g WHEN 'sigma' THEN (o OR e) AND m AND g AND nb WHEN 'cellprob' THEN e AND g ELSE g END AS ok
FROM b, (VALUES ('monai'), ('bg'), ('sigma'), ('cellprob'), ('branch_radius')) t(s)""")
def step_preconditions(spark, sf):
    return LS.step_preconditions(LS.discover_files(listing(spark, sf))).drop("reason")


@query("discovery_report", f"WITH {FILES} SELECT folder, k AS key, p IS NOT NULL AS found FROM (SELECT folder, o FROM fw), sx LEFT JOIN fd USING (folder, k)".replace("(SELECT folder, o FROM fw), sx", "(SELECT w.folder, sx.k FROM fw w, sx)"))
def discovery_report(spark, sf):
    return LS.discovery_report(LS.discover_files(listing(spark, sf))).select("folder", "key", "found")


@query("route", f"""WITH {FILES} SELECT folder, CASE WHEN ext_rm IS NOT NULL AND no_bg IS NOT NULL THEN 'both' WHEN ext_rm IS NOT NULL THEN 'fragments' WHEN no_bg IS NOT NULL THEN 'labelling' ELSE 'none' END AS route FROM fw""")
def route(spark, sf):
    return LS.route(listing(spark, sf))


@query("gt_samples", f"WITH {FILES} SELECT DISTINCT folder FROM fl WHERE ends_with(name, '_brain_mask.tif')")
def gt_samples(spark, sf):
    return LS.gt_samples(listing(spark, sf), "_brain_mask.tif")


@query("fish_key", f"""WITH {FILES} SELECT DISTINCT '/data/' || l_partkey || CASE WHEN l_partkey % 3 = 0 THEN '' ELSE '.tif' END AS path,
 CASE WHEN '/data/' || l_partkey IN (SELECT folder FROM fl) THEN '/data/' || l_partkey ELSE '/data' END AS fish_folder FROM lineitem""")
def fish_key(spark, sf):
    """Folders, raw files beside a folder, and files without one."""
    p = table(spark, sf, "lineitem").select(
        F.concat(F.lit("/data/"), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(".tif")).alias("path"))
    return LS.fish_key(p, listing(spark, sf))


@query("crop_pairs", """WITH f AS (SELECT DISTINCT '/c/' || l_returnflag AS folder, (['xy', 'xz', 'yz', 'zz'])[l_linenumber % 4 + 1] AS o, l_partkey AS s, l_linenumber AS c, l_suppkey % 2 = 0 AS m FROM lineitem)
SELECT a.folder, a.o || '_' || a.s || '_' || a.c AS stem, a.o AS orientation, CAST(a.s AS INT) AS slice_idx, a.c AS crop_no FROM f a JOIN f b USING (folder, o, s, c) WHERE a.m AND NOT b.m AND a.o <> 'zz'""")
def crop_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    o = F.array(*[F.lit(v) for v in ("xy", "xz", "yz", "zz")])[F.col("l_linenumber") % 4]
    name = F.concat_ws("_", o, F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))
    f = li.select(F.concat(F.lit("/c/"), "l_returnflag").alias("folder"), F.concat(name, F.when(F.col("l_suppkey") % 2 == 0, "_masks.tif").otherwise(".tif")).alias("name"))
    f = f.withColumn("path", F.concat("folder", F.lit("/"), "name")).distinct()
    return LS.crop_pairs(f).select("folder", "stem", "orientation", "slice_idx", "crop_no")


def metadata_texts(spark, sf):
    p = table(spark, sf, "part")
    mag = F.when(F.col("p_partkey") % 10 == 0, "x").otherwise(F.concat(F.lit("{DisplayName=TotalConsolidatedOpticalMagnification, Value=1."), (F.col("p_partkey") % 5).cast("string"), F.lit("}")))
    return p.select(
        F.concat(F.lit("/m/"), F.col("p_partkey").cast("string"), F.lit("_metadata.txt")).alias("path"),
        F.concat(
            F.lit("{DisplayName=Pixel Width (µm), Value="), F.format_string("%.1f", F.col("p_retailprice")), F.lit("}\n{DisplayName=Pixel Height (µm), Value="),
            F.format_string("%.3f", F.col("p_retailprice") / 2), F.lit("}\nStepSize="), F.col("p_size").cast("string"), F.lit("\n"), mag,
            F.lit("\n{DisplayName=TotalConsolidatedOpticalMagnification, Value=25}\n{DisplayName=TotalConsolidatedOpticalMagnification, Value=40}"),
        ).alias("value"),
    )


@query("parse_metadata", """SELECT '/m/' || p_partkey || '_metadata.txt' AS path, CAST(p_size AS DOUBLE) AS voxel_z_um, round(CAST(printf('%.3f', p_retailprice / 2) AS DOUBLE) / (25 * (1 + (p_partkey % 5) / 10.0::DOUBLE)), 6) AS voxel_y_um,
 round(CAST(printf('%.1f', p_retailprice) AS DOUBLE) / (25 * (1 + (p_partkey % 5) / 10.0::DOUBLE)), 6) AS voxel_x_um FROM part WHERE p_partkey % 10 <> 0""")
def parse_metadata(spark, sf):
    return rounded(SV.parse_metadata(metadata_texts(spark, sf)).drop("anisotropy"))


@query("match_metadata")
def match_metadata(spark, sf):
    """Image stems from part names, metadata stems from brands of the same type; half match exactly."""
    p = table(spark, sf, "part")
    stem = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), (F.col("p_partkey") % 50).cast("string"))
    img = p.select(F.col("p_type").alias("folder"), stem.alias("stem")).distinct()
    met = p.filter("p_partkey % 2 = 0").select(F.col("p_type").alias("folder"), stem.alias("meta_stem")).distinct()
    return SV.match_metadata(img, met).groupBy("folder", "exact").agg(F.count("*").alias("n"), F.round(F.min("ratio"), 4).alias("min_ratio"))


@query("resolve_scale", """SELECT o_orderkey AS path, CASE WHEN e.l_orderkey IS NOT NULL THEN 'external' WHEN o_custkey % 2 = 0 THEN 'embedded' ELSE 'default' END AS source,
 round(CASE WHEN e.l_orderkey IS NOT NULL THEN e.q WHEN o_custkey % 2 = 0 THEN 2.5 ELSE 1 END, 6) AS sz, round(CASE WHEN e.l_orderkey IS NOT NULL THEN e.q / 0.2 WHEN o_custkey % 2 = 0 THEN 2.5 / 0.2 ELSE 1 END, 6) AS anisotropy
 FROM orders LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL) e ON l_orderkey = o_orderkey""")
def resolve_scale(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").filter("l_linenumber = 1")
    small = [F.lit(0.2).alias("sy"), F.lit(0.2).alias("sx")]
    ext = li.groupBy(F.col("l_orderkey").alias("path")).agg(F.min("l_quantity").alias("sz")).select("path", "sz", *small)
    emb = o.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("path"), F.lit(2.5).alias("sz"), *small)
    return rounded(SV.resolve_scale(o.select(F.col("o_orderkey").alias("path")), ext, emb).select("path", "source", "sz", "anisotropy"))


# --- sinks -------------------------------------------------------------------------------------


@query("write_stats", with_(VOX, VOL, blocks_sql(), body="SELECT fish_id, label, count(*) AS volume_vox, min(z) AS bbox_z0 FROM blk GROUP BY ALL"))
def write_stats(spark, sf):
    """Statistics CSV written and read back."""
    from ..operators.objects import cell_summary

    path = scratch_path(spark, "csv")
    SK.write_stats(cell_summary(blocks(spark, sf)), path, ["volume_vox", "bbox_z0"])
    return spark.read.schema("fish_id string, label int, volume_vox long, bbox_z0 int").option("header", True).csv(path)


@query("write_artefacts", with_(VOX, VOL, blocks_sql(), BRAIN, body="""
SELECT 'cp_masks' AS artefact, fish_id, count(*) AS n FROM blk GROUP BY ALL UNION ALL SELECT 'brain_only_NoBG', fish_id, count(*) FROM vox JOIN brain USING (fish_id, z, y, x) GROUP BY ALL"""))
def write_artefacts(spark, sf):
    root = scratch_path(spark, "artefacts")
    SK.write_artefact(blocks(spark, sf), root, "cp_masks")
    only = apply_mask(vox(spark, sf), brain(spark, sf)).select("fish_id", *ZYX, "value")
    SK.write_artefact(only, root, "brain_only", 2)
    return spark.read.schema("fish_id string, z int, artefact string").parquet(root).groupBy("artefact", "fish_id").agg(F.count("*").alias("n"))


@query("build_package", with_(VOX, VOL, labels_sql("p", 20), body="""
SELECT fish_id, 'image' AS part, count(*) AS n_rows FROM vox GROUP BY ALL UNION ALL SELECT fish_id, 'raw', count(*) FROM p GROUP BY ALL UNION ALL
SELECT fish_id, 'corrected', count(*) FROM p WHERE label % 2 = 0 GROUP BY ALL UNION ALL SELECT fish_id, 'summary', count(DISTINCT label) FROM p WHERE label % 2 = 0 GROUP BY ALL"""))
def build_package(spark, sf):
    p = predicted(spark, sf)
    return SK.build_package(scratch_path(spark, "package"), vox(spark, sf), p.filter("label % 2 = 0"), p)


@query("training_samples", with_(VOX, VOL, BRAIN, body="""
, fv AS (SELECT v.fish_id, coalesce(x.value, 0) AS value FROM (SELECT fish_id, a.z, b.y, c.x FROM vol, range(0, 30) a(z), range(0, 100000) b(y), range(0, 24) c(x) WHERE b.y < ny) v LEFT JOIN vox x USING (fish_id, z, y, x))
SELECT fish_id, false AS has_brain_only, false AS has_skin_only, round(min(value), 6) AS volume_min, round(quantile_cont(value, 0.01), 6) AS volume_p01, round(quantile_cont(value, 0.99), 6) AS volume_p99, round(max(value), 6) AS volume_max FROM fv GROUP BY ALL""".strip()))
def training_samples(spark, sf):
    _, attrs = SK.training_samples(vox(spark, sf), brain(spark, sf), vol(spark, sf))
    return rounded(attrs.drop("nz", "ny", "nx"))


@query("training_rows", with_(VOX, VOL, BRAIN, body="""
SELECT fish_id, count(*) AS n, count(b) AS n_mask, round(sum(CASE WHEN b THEN coalesce(value, 0) ELSE 0 END), 4) AS brain_sum, round(sum(CASE WHEN b THEN 0 ELSE value END), 4) AS skin_sum
FROM (SELECT *, true AS b FROM brain) m FULL JOIN vox USING (fish_id, z, y, x) GROUP BY ALL"""))
def training_rows(spark, sf):
    rows, _ = SK.training_samples(vox(spark, sf), brain(spark, sf), vol(spark, sf))
    return rows.groupBy("fish_id").agg(F.count("*").alias("n"), F.sum(F.col("mask").cast("long")).alias("n_mask"),
                                       F.round(F.sum("brain_only"), 4).alias("brain_sum"), F.round(F.sum("skin_only"), 4).alias("skin_sum"))


@query("split_samples", "SELECT 'test' AS split, true AS positive, 5 AS n UNION ALL SELECT 'val', true, 5 UNION ALL SELECT 'train', true, count(*) FILTER (c_acctbal > 0) - 10 FROM customer UNION ALL SELECT 'train', false, count(*) FILTER (c_acctbal <= 0) FROM customer")
def split_samples(spark, sf):
    """Counts per split: five val, five test, negatives only in train."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("fish_id"), (F.col("c_acctbal") > 0).alias("positive"))
    return SW.split_samples(c).groupBy("split", "positive").agg(F.count("*").alias("n"))


@query("split_manifest", "SELECT c_mktsegment AS split, count(*) AS n, min(c_name) AS first_id FROM customer GROUP BY ALL")
def split_manifest(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("fish_id"), F.col("c_mktsegment").alias("split"))
    path = scratch_path(spark, "manifest")
    SK.write_manifest(c, path)
    return SK.split_manifest(spark.read.schema("fish_id string, seed int, split string").json(path))


@query("training_set")
def training_set(spark, sf):
    """Samples listed by their mask files, split and described."""
    ids = table(spark, sf, "customer").select((F.col("c_custkey")).cast("string").alias("c"), "c_acctbal")
    files = ids.select(F.concat(F.lit("/t/"), "c").alias("folder"), F.concat("c", F.when(F.col("c_acctbal") > 0, "_brain_mask.tif").otherwise("_skin_mask.tif")).alias("name"))
    o = table(spark, sf, "orders")
    v = o.groupBy(F.col("o_custkey").cast("string").alias("fish_id"), (F.month("o_orderdate") - 1).alias("z"), (F.dayofmonth("o_orderdate") - 1).alias("y"), F.lit(0).alias("x")).agg(F.sum("o_totalprice").alias("value"))
    dims = ids.select(F.col("c").alias("fish_id"), F.lit(12).alias("nz"), F.lit(31).alias("ny"), F.lit(1).alias("nx"))
    _, attrs, manifest = J.training_set(files, v, v.filter("z < 6").select("fish_id", *ZYX), dims)
    n = attrs.groupBy("split").agg(F.count("*").alias("n_described"), F.round(F.avg("volume_p99"), 4).alias("mean_p99"))
    return manifest.select("split", F.col("n").alias("n_listed")).join(n, "split", "left")


@query("polygons_round_trip", "SELECT event_type AS fish_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS z, count(*) AS n_points, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def polygons_round_trip(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("fish_id"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("z"))
    poly = e.agg(F.collect_list(F.struct(F.col("value").alias("y"), F.col("user_id").cast("double").alias("x"))).alias("pts"))
    path = scratch_path(spark, "polygons")
    SV.write_polygons(poly, path)
    back = SV.read_polygons(spark, path).select("fish_id", "z", F.explode("pts").alias("p"))
    return back.groupBy("fish_id", "z").agg(F.count("*").alias("n_points"), F.round(F.sum("p.y"), 4).alias("total"))


@query("voxels_round_trip", with_(VOX, body="SELECT fish_id, channel, count(*) AS n, round(sum(value), 4) AS total FROM vox GROUP BY ALL"))
def voxels_round_trip(spark, sf):
    """Voxel table written by sample and channel, read back with its scale."""
    path = scratch_path(spark, "voxels")
    SV.write_voxels(vox(spark, sf), path)
    vol(spark, sf).write.parquet(path + "-dims")
    back = SV.read_voxels(spark, path, path + "-dims")
    return back.groupBy("fish_id", "channel").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("cached_stage", with_(VOX, body="SELECT fish_id, count(*) AS n, true AS reused FROM vox GROUP BY ALL"))
def cached_stage(spark, sf):
    """The second request with a near-equal float fingerprint reads the first one's table."""
    root, calls = scratch_path(spark, "cache"), []

    def build():
        calls.append(1)
        return vox(spark, sf)

    SV.cached_stage(spark, root, {"model": "m", "anisotropy": 5.747}, build)
    t = SV.cached_stage(spark, root, {"model": "m", "anisotropy": 5.747 * (1 + 1e-6)}, build)
    return t.groupBy("fish_id").agg(F.count("*").alias("n")).withColumn("reused", F.lit(len(calls) == 1))


# --- streams: the events table read as a file stream -----------------------------------------------


def stream_table(spark, sf, name, df=None):
    path = scratch_path(spark, name)
    (df if df is not None else table(spark, sf, name)).write.parquet(path)
    return spark.readStream.schema((df if df is not None else table(spark, sf, name)).schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_metrics", f"WITH {LOG} SELECT run_id, seq, CAST(seq AS INT) AS epoch, value FROM lg")
def stream_metrics(spark, sf):
    lines = stream_table(spark, sf, "log", log_lines(spark, sf).select("run_id", "seq", "line"))
    out = scratch_path(spark, "out")
    return ST.run_to_table(ST.stream_metrics(lines), out, out + "-cp").drop("batch_id")


MONITOR_SQL = f"""WITH {LOG}, b AS (SELECT run_id, value AS best_value, seq AS best_seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value, seq) AS r FROM lg) WHERE r = 1)
SELECT run_id, count(*) AS n_checkpoints, min(best_value) AS best_value, CAST(min(best_seq) AS INT) AS best_epoch, count(*) FILTER (seq > best_seq) AS checkpoints_since_best,
 count(*) FILTER (seq > best_seq) >= 500 AS exceeded FROM lg JOIN b USING (run_id) GROUP BY ALL"""


@query("stream_monitor", MONITOR_SQL)
def stream_monitor(spark, sf):
    """Stateful early-stop monitor over micro-batches; the last row per run equals the batch result."""
    lines = stream_table(spark, sf, "log", log_lines(spark, sf).select("run_id", "seq", "line"))
    out = scratch_path(spark, "out")
    return ST.latest_per_run(ST.run_to_table(ST.monitor(ST.stream_metrics(lines), 500, False), out, out + "-cp", "update"))


@query("stream_monitor_late", MONITOR_SQL)
def stream_monitor_late(spark, sf):
    """The same log dealt over micro-batches by a hash, so most lines come late."""
    lines = log_lines(spark, sf).select("run_id", "seq", "line").repartition(5, F.xxhash64("seq"))
    out = scratch_path(spark, "out")
    stream = stream_table(spark, sf, "log", lines)
    return ST.latest_per_run(ST.run_to_table(ST.monitor(ST.stream_metrics(stream), 500, False), out, out + "-cp", "update"))


@query("stream_history", f"""WITH {HIST} SELECT config_key, CASE config_key WHEN 'min_volume_vox' THEN 'min' WHEN 'max_volume_vox' THEN 'max' ELSE 'mean' END AS mode,
 round(CASE config_key WHEN 'min_volume_vox' THEN min(value) WHEN 'max_volume_vox' THEN max(value) WHEN 'erosion_voxels' THEN round_even(avg(value), 0) ELSE avg(value) END, 6) AS value, count(*) AS n_samples FROM lt GROUP BY config_key""")
def stream_history(spark, sf):
    s = stream_table(spark, sf, "history", history(spark, sf))
    out = scratch_path(spark, "hist")
    return rounded(ST.recommend_stream(s, out, out + "-cp"))


# --- composed jobs -----------------------------------------------------------------------------------


@query("brain_extraction", with_(VOX, PROBS, "t AS (SELECT fish_id, z, y, x FROM probs WHERE p > 0.1)", cc_sql("t", "c", 6), body="""
, s AS (SELECT fish_id, component, count(*) AS n FROM c GROUP BY ALL),
b AS (SELECT fish_id, component FROM (SELECT *, row_number() OVER (PARTITION BY fish_id ORDER BY n DESC, component) AS r FROM s) WHERE r = 1)
SELECT fish_id, count(*) AS n, round(sum(value), 4) AS total FROM vox JOIN c USING (fish_id, z, y, x) JOIN b USING (fish_id, component) GROUP BY ALL""".strip()))
def brain_extraction(spark, sf):
    """Mode 0: cut by the largest component (its holes hold no voxels on this data)."""
    _, only = J.brain_extraction(probs(spark, sf), vox(spark, sf), vol(spark, sf), 0.1)
    return only.groupBy("fish_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


for _mode in (1, 2, 3):

    @query(f"brain_extraction_mode{_mode}")
    def _extract(spark, sf, mode=_mode):
        p = brain(spark, sf).withColumn("p", F.lit(0.9))
        _, only = J.brain_extraction(p, vox(spark, sf), vol(spark, sf), 0.5, 1, mode, 1.0)
        return only.groupBy("fish_id").agg(F.count("*").alias("n"))


@query("correct_labels")
def correct_labels(spark, sf):
    _, counts, _ = J.correct_labels(predicted(spark, sf), vol(spark, sf), 0.4, 3, 6, 8)
    return counts


@query("compute_stats")
def compute_stats(spark, sf):
    """The full statistics table with intensity, regions and descriptions."""
    from .measuring import lines

    names = vol(spark, sf).select("fish_id", F.array(F.lit("front"), F.lit("middle"), F.lit("back")).alias("names"))
    return J.compute_stats(truth(spark, sf), vol(spark, sf), SCALE, vox(spark, sf), lines(spark, sf), names)


@query("background_sweep")
def background_sweep(spark, sf):
    """Two tolerances by two erosions on the most branched cells of each sample; sizes from ground truth."""
    r, _, _ = J.background_sweep(
        vox(spark, sf), brain(spark, sf), truth(spark, sf), vol(spark, sf), None, [0.0, 5.0], [0, 1], 0.4, 0.4, pad_z=3, pad_xy=4, scale_zyx=SCALE
    )
    return rounded(r)


@query("sigma_sweep")
def sigma_sweep(spark, sf):
    """Two widths in the plane on the most branched cells of each sample, over what the background cut leaves."""
    from ..operators.masks import remove_global

    only = remove_global(vox(spark, sf), brain(spark, sf), vol(spark, sf), 0.05)
    r, _, _ = J.sigma_sweep(only, truth(spark, sf), vol(spark, sf), None, SIGMAS_XY, SIGMAS_Z, pad_z=3, pad_xy=4, scale_zyx=SCALE)
    return rounded(r)


@query("fragment_sweep")
def fragment_sweep(spark, sf):
    """Two probability cuts, one contact threshold, scored one-to-one."""
    from ..operators.components import label_components

    p = probs(spark, sf)
    cut = SW.cross_grid(p, [(0.3, 0.0), (0.4, 0.0)]).drop("p2").filter("p > p1")
    frags = materialize(label_components(cut.select("fish_id", "p1", *ZYX), ["fish_id", "p1"]))
    r, _ = J.fragment_sweep(frags, truth(spark, sf), vol(spark, sf), [6], max_gap=0.4, min_contact=3, gt_min=8)
    return rounded(r)


@query("checkpoint_sweep", with_(VOX, labels_sql("g", 0), labels_sql("e1", 20), labels_sql("e2", 40), body="""
, p AS (SELECT 10 AS epoch, * FROM e1 UNION ALL SELECT 20, * FROM e2), c AS (SELECT * FROM g),
ov AS (SELECT epoch, c.fish_id, c.label, p.label AS pred, count(*) AS n FROM c JOIN p USING (fish_id, z, y, x) GROUP BY ALL),
vc AS (SELECT fish_id, label, count(*) AS gv FROM c GROUP BY ALL), vp AS (SELECT epoch, fish_id, label AS pred, count(*) AS pv FROM p GROUP BY ALL),
b AS (SELECT epoch, fish_id, label, max(n * 1.0::DOUBLE / (gv + pv - n)) AS iou FROM ov JOIN vc USING (fish_id, label) JOIN vp USING (epoch, fish_id, pred) GROUP BY ALL)
SELECT vc.fish_id, e.epoch AS p1, round(avg(coalesce(iou, 0) * 100), 6) AS iou, count(*) AS n_scored FROM vc, (VALUES (10), (20)) e(epoch) LEFT JOIN b ON b.fish_id = vc.fish_id AND b.label = vc.label AND b.epoch = e.epoch GROUP BY ALL""".strip().replace("vc, (VALUES (10), (20)) e(epoch)", "vc JOIN (VALUES (10), (20)) e(epoch) ON true")))
def checkpoint_sweep(spark, sf):
    """Label sets of two checkpoints scored on every true cell."""
    g = truth(spark, sf)
    _, avg, _ = J.checkpoint_sweep(*_two_epochs(spark, sf, g), g.select("fish_id", "label").distinct())
    return rounded(avg.select("fish_id", F.col("p1").cast("int").alias("p1"), "iou", "n_scored"))


def _two_epochs(spark, sf, g):
    from ..operators.components import label_components

    e1 = predicted(spark, sf).withColumn("epoch", F.lit(10))
    e2 = label_components(occupied(spark, sf, 40.0)).withColumn("epoch", F.lit(20))
    return e1.unionByName(e2), g, spark.range(10, 30, 10).select(F.col("id").cast("int").alias("epoch"))


@query("checkpoint_sweep_ranked")
def checkpoint_sweep_ranked(spark, sf):
    """The same on the five most branched cells of each sample."""
    _, avg, _ = J.checkpoint_sweep(*_two_epochs(spark, sf, truth(spark, sf)), scale_zyx=SCALE)
    return rounded(avg.select("fish_id", F.col("p1").cast("int").alias("p1"), "iou", "n_scored"))


@query("repoint", with_(VOX, labels_sql("g", 0), labels_sql("e1", 20), labels_sql("e2", 40), body="""
, p AS (SELECT 10 AS epoch, * FROM e1 UNION ALL SELECT 20, * FROM e2),
ov AS (SELECT epoch, g.fish_id, g.label, p.label AS pred, count(*) AS n FROM g JOIN p USING (fish_id, z, y, x) GROUP BY ALL),
vc AS (SELECT fish_id, label, count(*) AS gv FROM g GROUP BY ALL), vp AS (SELECT epoch, fish_id, label AS pred, count(*) AS pv FROM p GROUP BY ALL),
b AS (SELECT epoch, fish_id, label, max(n * 1.0::DOUBLE / (gv + pv - n)) AS iou FROM ov JOIN vc USING (fish_id, label) JOIN vp USING (epoch, fish_id, pred) GROUP BY ALL),
a AS (SELECT vc.fish_id, e.epoch, avg(coalesce(iou, 0) * 100) AS iou FROM vc JOIN (VALUES (10), (20)) e(epoch) ON true LEFT JOIN b ON b.fish_id = vc.fish_id AND b.label = vc.label AND b.epoch = e.epoch GROUP BY ALL),
w AS (SELECT fish_id, epoch FROM (SELECT *, row_number() OVER (PARTITION BY fish_id ORDER BY iou DESC, epoch) AS r FROM a) WHERE r = 1)
SELECT 'm_' || fish_id AS model, printf('m_%s_epoch_%04d', fish_id, CASE WHEN fish_id = 'error' THEN 20 ELSE epoch END) AS target FROM w""".strip()))
def repoint(spark, sf):
    """Every sample's model points at epoch 20; the sweep's winner replaces it where the sample is verified."""
    g = truth(spark, sf)
    _, _, best = J.checkpoint_sweep(*_two_epochs(spark, sf, g), g.select("fish_id", "label").distinct())
    best = materialize(best.withColumn("model", F.concat(F.lit("m_"), "fish_id")))
    models = g.select(F.concat(F.lit("m_"), "fish_id").alias("model")).distinct()
    names = models.withColumn("epoch", F.explode(F.array(F.lit(10), F.lit(20))))
    checkpoints = names.select(F.format_string("%s_epoch_%04d", "model", "epoch").alias("name"))
    old = SV.write_pointer(checkpoints, models.withColumn("epoch", F.lit(20)), scratch_path(spark, "pointers"))
    verified = g.select("fish_id").distinct().withColumn("verified", F.col("fish_id") != "error")
    return SV.resolve_pointers(J.repoint(old, best, verified), checkpoints).select("model", "target")


@query("calibration_suite")
def calibration_suite(spark, sf):
    """Every key measured on every sample; all but one sample are verified. With the mean score the sweeps' best points reached."""
    g = truth(spark, sf)
    ok = g.select("fish_id").distinct().withColumn("verified", F.col("fish_id") != "error")
    p = probs(spark, sf)
    cut = SW.cross_grid(p, [(0.3, 0.0), (0.4, 0.0)]).drop("p2").filter("p > p1")
    from ..operators.components import label_components

    frags = materialize(label_components(cut.select("fish_id", "p1", *ZYX), ["fish_id", "p1"]))
    history, found = J.calibration_suite(
        g, vol(spark, sf), vox(spark, sf), ok, F.lit("2024-02-01").cast("timestamp"), SCALE, p, gt_mask(spark, sf), frags,
        thresholds=(0.05, 0.2), sigma_xys=SIGMAS_XY, sigma_zs=SIGMAS_Z, large_contacts=(6,), pad_z=3, pad_xy=4,
        sigma_xy=SIGMAS_XY[0], sigma_z=SIGMAS_Z[0], max_gap=0.4, min_contact=3, gt_min=8,
    )
    reached = history.filter("verified").groupBy("config_key").agg(F.avg("score").alias("score"))
    return rounded(found.join(reached, "config_key", "left"))


@query("rerun_object")
def rerun_object(spark, sf):
    """The largest cell of each sample is redone from the finer fragments."""
    from ..operators.labels import relabel_by_volume

    g = materialize(relabel_by_volume(truth(spark, sf)))
    req = g.filter("label = 1").select("fish_id", "label").distinct()
    out, _ = J.rerun_object(g, req, predicted(spark, sf), vol(spark, sf), vol(spark, sf), 2, 3, max_gap=0.2, min_contact=2, large_contact=3, gt_min=5)
    return out.groupBy("fish_id").agg(F.countDistinct("label").alias("n_labels"), F.count("*").alias("n_voxels"))


@query("tile_score", with_(VOX, VOL, body="""
SELECT fish_id, nz * ny * nx AS n_sites, coalesce(k.n, 0) AS n_on FROM vol LEFT JOIN (SELECT fish_id, count(*) AS n FROM vox WHERE value > 20 GROUP BY ALL) k USING (fish_id)"""))
def tile_score_query(spark, sf):
    """A site-wise predictor gives the same answer in every tile, so blending must return it."""
    v = vox(spark, sf).select("fish_id", *ZYX, F.col("value").alias("norm"))
    p = tile_score(v, vol(spark, sf), lambda d: d - 20.0, (12, 16, 16), 0.25)
    return p.groupBy("fish_id").agg(F.count("*").alias("n_sites"), F.sum((F.col("p") > 0.5).cast("long")).alias("n_on"))
