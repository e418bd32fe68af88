"""Registry and shared inputs: volumes, labels, masks and listings derived from the given tables.

Each input exists twice, as a DataFrame function and as DuckDB common table
expressions, so that every query can be checked against plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.components import components, label_components
from ..schemas import ZYX
from ..session import materialize, true_sizes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SCALE = (1.00703, 0.17321, 0.17411)  # um per voxel; odd values keep rounded results off ties


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where one exists."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(true_sizes(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- volumes from events ------------------------------------------------------


def vox(spark: SparkSession, sf: str) -> DataFrame:
    """One sample per event type: day = z, user block = y, hour = x, summed value."""
    e = table(spark, sf, "events")
    z = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(
        F.col("event_type").alias("fish_id"), F.lit(0).alias("channel"), z.alias("z"),
        F.expr("CAST(user_id DIV 5 AS INT)").alias("y"), F.hour("ts").alias("x"),
    ).agg(F.sum("value").alias("value"))


def vol(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    size = e.groupBy(F.col("event_type").alias("fish_id")).agg(F.expr("CAST(max(user_id) DIV 5 AS INT) + 1").alias("ny"))
    sz, sy, sx = SCALE
    return size.select(
        "fish_id", F.lit(0).alias("channel"), F.lit(30).alias("nz"), "ny", F.lit(24).alias("nx"), F.lit(sz).alias("sz"),
        F.lit(sy).alias("sy"), F.lit(sx).alias("sx"), F.lit(sz / ((sy + sx) / 2)).alias("anisotropy"), F.lit("table").alias("source"),
    )


VOX = """vox AS (
  SELECT event_type AS fish_id, 0 AS channel,
         CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS z,
         CAST(user_id // 5 AS INT) AS y, CAST(extract(hour FROM ts) AS INT) AS x, SUM(value) AS value
  FROM events GROUP BY ALL)"""
VOL = f"""vol AS (
  SELECT event_type AS fish_id, 30 AS nz, CAST(max(user_id) // 5 AS INT) + 1 AS ny, 24 AS nx,
         CAST({SCALE[0]} AS DOUBLE) AS sz, CAST({SCALE[1]} AS DOUBLE) AS sy, CAST({SCALE[2]} AS DOUBLE) AS sx FROM events GROUP BY ALL)"""


def occupied(spark: SparkSession, sf: str, cut: float = 0.0) -> DataFrame:
    return vox(spark, sf).filter(F.col("value") > cut).select("fish_id", *ZYX)


def occ_sql(name: str, cut: float) -> str:
    return f"{name} AS (SELECT fish_id, z, y, x FROM vox WHERE value > {cut})"


def brain(spark: SparkSession, sf: str) -> DataFrame:
    """A box mask on the full lattice, so absent voxels inside it count."""
    v = vol(spark, sf).withColumn("z", F.explode(F.expr("sequence(2, 27)")))
    v = v.withColumn("y", F.explode(F.expr("sequence(0, ny - 1)"))).repartition("fish_id", "z", "y")
    v = v.withColumn("x", F.explode(F.expr("sequence(4, 19)")))
    return v.select("fish_id", *ZYX)


BRAIN = """brain AS (
  SELECT fish_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM vol, range(2, 28) a(z), range(4, 20) b(x), range(0, 100000) c(y)
  WHERE y < ny)"""


def probs(spark: SparkSession, sf: str) -> DataFrame:
    return vox(spark, sf).select("fish_id", *ZYX, (F.col("value") / (F.col("value") + 40)).alias("p"))


PROBS = "probs AS (SELECT fish_id, z, y, x, value / (value + 40) AS p FROM vox)"


def blocks(spark: SparkSession, sf: str, cut: float = 20.0) -> DataFrame:
    """Label set by lattice block: cells of 6 x 10 x 8 sites."""
    lab = F.expr("CAST(1 + (z DIV 6) + 5 * (x DIV 8) + 15 * (y DIV 10) AS INT)")
    return occupied(spark, sf, cut).withColumn("label", lab)


def blocks_sql(name: str = "blk", cut: float = 20.0) -> str:
    return (
        f"{name} AS (SELECT fish_id, z, y, x, CAST(1 + (z // 6) + 5 * (x // 8) + 15 * (y // 10) AS INT) AS label "
        f"FROM vox WHERE value > {cut})"
    )


# --- components -----------------------------------------------------------------


def found(spark: SparkSession, sf: str, cut: float, conn: int = 26) -> DataFrame:
    return components(occupied(spark, sf, cut), conn=conn)


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Ground-truth labels: components of all occupied voxels."""
    return materialize(label_components(occupied(spark, sf, 0.0)), "truth")


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted labels: components above 20; they nest in the truth."""
    return materialize(label_components(occupied(spark, sf, 20.0)), "predicted")


def offsets_sql(conn: int) -> str:
    from ..operators.components import half_offsets

    half = half_offsets(conn)
    return ", ".join(f"({a}, {b}, {c})" for o in half for a, b, c in (o, tuple(-v for v in o)))


def cc_sql(src: str, out: str, conn: int = 26, scope: str = "fish_id") -> str:
    """CTEs giving ``out``(scope.., z, y, x, component): lowest packed voxel id reachable."""
    cols = [c.strip() for c in scope.split(",")]
    on = " AND ".join(f"b.{c} = a.{c}" for c in cols)
    sc = ", ".join(cols)
    a_sc, r_sc = ", ".join(f"a.{c}" for c in cols), ", ".join(f"r.{c}" for c in cols)
    rn = " AND ".join(f"e.{c} = r.{c}" for c in cols)
    un = " AND ".join(f"m.{c} = n.{c}" for c in cols)
    return f"""{out}_n AS (SELECT {sc}, z, y, x, CAST(z AS BIGINT) * 4398046511104 + CAST(y AS BIGINT) * 2097152 + x AS id FROM {src}),
{out}_e AS (SELECT {a_sc}, a.id AS a, b.id AS b FROM {out}_n a, (VALUES {offsets_sql(conn)}) d(dz, dy, dx), {out}_n b
  WHERE {on} AND b.z = a.z + d.dz AND b.y = a.y + d.dy AND b.x = a.x + d.dx),
{out}_r({sc}, node, root) AS (SELECT {sc}, id, id FROM {out}_n UNION
  SELECT {r_sc}, e.b, r.root FROM {out}_r r JOIN {out}_e e ON {rn} AND e.a = r.node WHERE e.b > r.root),
{out}_m AS (SELECT {sc}, node, min(root) AS component FROM {out}_r GROUP BY {sc}, node),
{out} AS (SELECT n.*, m.component FROM {out}_n n JOIN {out}_m m ON {un} AND m.node = n.id)"""


def labels_sql(name: str, cut: float) -> str:
    """CTEs for components above ``cut`` numbered in raster order."""
    return (
        f"{occ_sql(name + '_o', cut)},\n{cc_sql(name + '_o', name + '_c')},\n"
        f"{name} AS (SELECT fish_id, z, y, x, CAST(dense_rank() OVER (PARTITION BY fish_id ORDER BY component) AS INT) AS label FROM {name}_c)"
    )


def with_(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def info_sql(src: str, out: str, keys: str = "fish_id") -> str:
    return (
        f"{out} AS (SELECT {keys}, label, count(*) AS volume_vox, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, min(z) AS z0, min(y) AS y0, "
        f"min(x) AS x0, max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM {src} GROUP BY {keys}, label)"
    )
