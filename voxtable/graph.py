"""Connected groups of a node graph by alternating large-star / small-star rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .session import is_empty, materialize


def _large_star(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = edges.select(*keys, "u", "v").unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.filter("v > u").join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _small_star(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    down = edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    out = down.join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select(*keys, "u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _is_star_forest(edges: DataFrame, keys: Sequence[str]) -> bool:
    roles = edges.select(*keys, F.col("u").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(
        edges.select(*keys, F.col("v").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("p"))
    )
    bad = roles.groupBy(*keys, "n").agg(F.sum("c").alias("c"), F.max("p").alias("p"))
    return is_empty(bad.filter("c > 1 or (c = 1 and p = 1)"))


def connected(edges: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(keys, node, root) for every node on an edge; root = lowest node id of the group.

    Rounds needed grow with the logarithm of the longest chain. Node minima are
    partial aggregates, so a hub node is combined map-side.
    """
    cur = edges.select(*keys, F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    cur = materialize(cur, "edges")
    if not is_empty(cur):
        for _ in range(max_rounds):
            if _is_star_forest(cur, keys):
                break
            cur = materialize(_small_star(_large_star(cur, keys), keys), "stars")
        else:
            raise RuntimeError("component search did not converge")
    low = cur.select(*keys, F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return low.unionByName(low.select(*keys, F.col("root").alias("node"), "root")).distinct()
