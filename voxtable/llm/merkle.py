"""Merkle manifest of a dataset, and proofs of its rows by descent through a content-addressed graph.

Every row is a leaf; runs of eight consecutive nodes of a group become their parent until one node remains, and the
groups' roots are joined the same way.  Each level is a table of digest-to-children records.  Leaf requests start
together at the root: the rows of one level are looked up by digest, each child takes the requests whose next rank
digit selects it, and the children not selected on the way are the proof.  So requests that share a path share its
look-ups, the number of rows only grows as they part, and no key collects them.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

WIDTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(cols: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def fold(path: Column, digest: Column) -> Column:
    """The root that follows from a leaf digest and its path, leaf to root."""
    return F.aggregate(path, digest, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All sibling digests of a path as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def ranked(nodes: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``nodes`` (with ``grp``) with ``idx``, the rank in its group by ``order`` from 0, and ``n``, the group's size.

    Rows are range-partitioned, so a group of any size is ranked by many tasks; equal rows are parted by their place
    in the input.  Only one count per group and partition is summed up along a group.
    """
    order = [*order, "_row"]
    dealt = materialize(
        nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("grp", *order)
        .withColumn("_part", F.spark_partition_id()), f"{tag}-dealt")
    along = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("grp", "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "grp", "_part", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    here = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("grp", "_part").orderBy(*order)) - 1)
    return here.join(starts, ["grp", "_part"]).withColumn("idx", F.col("_start") + F.col("_at")).drop("_row", "_part", "_at", "_start")


@dataclass
class Tree:
    """Leaves (``grp, n, idx, digest``), one table of records per level above them, and the root of every group.

    A group of n leaves ends at the first level whose nodes span n leaves.
    """

    leaves: DataFrame
    levels: list[DataFrame]  # levels[k - 1]: grp, n, idx, digest, children

    def ends(self, level: int) -> Column:
        return (F.col("n") <= WIDTH**level) & ((F.col("n") > WIDTH ** (level - 1)) if level else F.lit(True))

    def roots(self) -> DataFrame:
        cols = ["grp", "n", "digest"]
        out = self.leaves.filter(self.ends(0)).select(*cols)
        for k, nodes in enumerate(self.levels, 1):
            out = out.unionByName(nodes.filter(self.ends(k)).select(*cols))
        return out


def grow(leaves: DataFrame, tag: str) -> Tree:
    """Levels above ranked leaves; groups of one node are not carried further."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    tree, below = Tree(leaves, []), leaves
    while WIDTH ** len(tree.levels) < most:
        span = WIDTH ** len(tree.levels)
        run = F.sort_array(F.collect_list(F.struct("pos", "digest")))  # at most WIDTH nodes
        nodes = below.filter(F.col("n") > span).select(
            "grp", "n", F.floor(F.col("idx") / WIDTH).alias("idx"), (F.col("idx") % WIDTH).alias("pos"), "digest",
        ).groupBy("grp", "n", "idx").agg(run.alias("run")).select(
            "grp", "n", "idx", F.transform("run", lambda x: x["digest"]).alias("children"))
        below = materialize(
            nodes.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"{tag}-level{len(tree.levels) + 1}")
        tree.levels.append(below)
    return tree


@dataclass
class Manifest:
    rows: DataFrame  # grp, n, idx, digest and the id and payload columns of every leaf
    groups: Tree  # the trees of all groups
    top: Tree  # the tree over the groups' roots; its leaves also have name (the grp), size and the subroot
    root: str | None  # None without rows


def build_manifest(docs: DataFrame, payload: dict[str, Column] | None = None, id_col: str = "doc_id",
                   group_col: str = "lang", fields: tuple[str, ...] = FIELDS) -> Manifest:
    """Manifest of ``docs``: leaves of ``fields``, in groups of ``group_col`` (null is a group of its own), by id.

    ``payload`` columns travel with a leaf and are no part of it.  Null ids come first; rows that repeat an id follow
    each other by digest; fully equal rows are leaves of their own.  Other columns of ``docs`` are not read.
    """
    lang = F.col(group_col).cast("string")
    rows = docs.select(
        F.when(lang.isNull(), "").otherwise(F.concat(F.lit("+"), lang)).alias("grp"),  # null sorts first
        F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in fields]).alias("digest"),
        *[c.alias(name) for name, c in (payload or {}).items()])
    rows = materialize(ranked(rows, ["id", "digest"], "merkle"), "merkle-leaves")
    groups = grow(rows.select("grp", "n", "idx", "digest"), "merkle")
    subroots = groups.roots().select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("n").alias("size"), "digest")
    top = grow(materialize(ranked(subroots, ["name"], "merkle-top"), "merkle-subroots"), "merkle-top")
    root = top.roots().select("digest").first()
    return Manifest(rows, groups, top, root[0] if root else None)


def _descend(tree: Tree, start: DataFrame, keep: list[str], wanted: DataFrame | None, tag: str, stop: int = 0) -> list[DataFrame]:
    """Follow ``start`` (roots: grp, n, idx 0, digest, path and ``keep``) down to level ``stop``.

    Returns the nodes reached there, after them those of groups that end at lower levels, level by level.
    ``wanted`` (grp, idx of leaves) limits the descent to nodes above such leaves.
    """
    reached, cols = None, ["grp", "n", "idx", "digest", "path", *keep]
    for k in range(len(tree.levels), stop, -1):
        here = start.filter(tree.ends(k)).select(*cols)
        here = here if reached is None else reached.unionByName(here)
        records = tree.levels[k - 1].select("digest", "children").dropDuplicates(["digest"])
        rest = [c for c in cols if c not in ("idx", "digest", "path")]
        below = here.join(records, "digest").select(
            *rest, "idx", "path", "children", F.posexplode("children").alias("pos", "child")
        ).select(
            *rest, (F.col("idx") * WIDTH + F.col("pos")).alias("idx"), F.col("child").alias("digest"),
            F.concat("path", F.array(_segment(F.col("children"), F.col("pos")))).alias("path"))
        if wanted is not None:
            asked = wanted.select("grp", F.floor(F.col("idx") / WIDTH ** (k - 1)).alias("idx")).distinct()
            below = below.join(asked, ["grp", "idx"], "left_semi")
        reached = materialize(below.select(*cols), f"{tag}-down{k - 1}")
    lower = [start.filter(tree.ends(k)).select(*cols) for k in range(min(stop, len(tree.levels)), -1, -1)]
    return ([reached] if reached is not None else []) + lower


def _segment(children: Column, pos: Column) -> Column:
    """The children on both sides of the selected one."""
    left = F.array_join(F.slice(children, F.lit(1), pos), "")
    return F.struct(left.alias("left"), F.array_join(F.slice(children, pos + 2, F.lit(WIDTH)), "").alias("right"))


def prove(manifest: Manifest, ids: DataFrame | None = None) -> DataFrame:
    """``id, digest``, the payload, ``subroot`` and ``path`` (leaf to root: siblings left and right) of every leaf.

    With ``ids`` (a column ``id``) only of leaves of such ids, and only the graph above them is looked up.  An empty
    manifest has no proofs.
    """
    rows, wanted = manifest.rows, None
    if ids is not None:
        rows = rows.join(ids.select("id").distinct(), "id", "left_semi")
        wanted = materialize(rows.select("grp", "idx"), "merkle-wanted")
    payload = [c for c in rows.columns if c not in ("grp", "n", "idx")]
    empty = F.array().cast(PATH)

    top = manifest.top.roots().select(
        "grp", "n", F.lit(0).cast("long").alias("idx"), "digest", empty.alias("path"))
    names = manifest.top.leaves.select("idx", F.col("name"), "size")
    reached = None
    for part in _descend(manifest.top, top, [], None, "merkle-top"):
        reached = part if reached is None else reached.unionByName(part)
    starts = materialize(reached.select("idx", "digest", "path").join(names, "idx").select(
        F.col("name").alias("grp"), F.col("size").alias("n"), F.lit(0).cast("long").alias("idx"), "digest", "path",
        F.col("digest").alias("subroot")), "merkle-starts")

    # the last step opens each run of leaves where it stands, so a row with its whole path is never shuffled
    parts = _descend(manifest.groups, starts, ["subroot"], wanted, "merkle", stop=1)
    lone, runs = parts[-1], parts[:-1]
    asked = rows.select("grp", F.floor(F.col("idx") / WIDTH).alias("idx"), F.struct((F.col("idx") % WIDTH).cast("int").alias("pos"), *payload).alias("leaf"))
    out = lone.select("grp", "path", "subroot").join(rows.filter(manifest.groups.ends(0)), "grp").select(*payload, "subroot", F.reverse("path").alias("path"))
    if manifest.groups.levels:
        nodes = None
        for part in runs:
            nodes = part if nodes is None else nodes.unionByName(part)
        records = manifest.groups.levels[0].select("digest", "children").dropDuplicates(["digest"])
        opened = nodes.join(records, "digest").join(
            asked.groupBy("grp", "idx").agg(F.collect_list("leaf").alias("leaves")), ["grp", "idx"],  # at most WIDTH leaves
        ).select("path", "children", "subroot", F.explode("leaves").alias("leaf"))
        out = out.unionByName(opened.select(
            *[F.col(f"leaf.{c}").alias(c) for c in payload], "subroot",
            F.reverse(F.concat("path", F.array(_segment(F.col("children"), F.col("leaf.pos"))))).alias("path")))
    return out


def audit(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Proof and verification of every row, after a tampering that lower-cases A-Z in the texts of one id in three.

    A row whose tampered leaf is the original one (null text, or no A-Z) verifies.  Null ids are not tampered with.
    """
    text = F.translate(F.col("text"), ascii_uppercase, ascii_lowercase)
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    changed = F.when(hit, leaf_digest([text if c == "text" else F.col(c) for c in FIELDS]))
    manifest = build_manifest(docs, {"changed": changed}, id_col)
    path = F.col("path")
    return prove(manifest).select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"),
        F.sha2(siblings(path), 256).alias("proof_sha256"), fold(path, F.coalesce("changed", "digest")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
