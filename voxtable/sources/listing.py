"""File listings: sample folders, artefacts, preconditions, routes and crop pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: artefact key and file ending
SUFFIXES = {
    "original": "_original.tif",
    "brain_mask": "_brain_mask.tif",
    "ext_rm": "_brain_only_ExtRm.tif",
    "no_bg": "_brain_only_NoBG.tif",
    "rnd_fill": "_brain_only_RndFill.tif",
    "cp_masks": "_cp_masks.tif",
    "cp_masks_corrected": "_cp_masks_corrected.tif",
    "ground_truth": "_GROUND_TRUTH.tif",
    "statistics_csv": "_statistics.csv",
}
# fixed values: background mode and file-name ending
MODE_SUFFIX = {0: "", 1: "_ExtRm", 2: "_NoBG", 3: "_RndFill"}


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, name) of every file under ``root``; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return split_path(f)


def split_path(paths: DataFrame) -> DataFrame:
    return paths.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn(
        "name", F.regexp_extract("path", r"([^/]*)$", 1)
    )


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def fish_key(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Sample folder of a path: itself if a folder, else the folder beside it with its stem, else its parent.

    ``folders``: folder.
    """
    known = folders.select(F.col("folder").alias("_f")).distinct()
    p = split_path(paths.select("path").distinct())
    p = p.withColumn("_beside", F.concat("folder", F.lit("/"), stem_of(F.col("name"))))
    own = known.select(F.col("_f").alias("path"), F.lit(True).alias("_own"))
    beside = known.select(F.col("_f").alias("_beside"), F.lit(True).alias("_side"))
    p = p.join(own, "path", "left").join(beside, "_beside", "left")
    return p.select(
        "path",
        F.when(F.col("_own"), F.col("path")).when(F.col("_side"), F.col("_beside")).otherwise(F.col("folder")).alias("fish_folder"),
    )


def discover_files(listing: DataFrame) -> DataFrame:
    """One row per folder, one column per artefact: the exact {stem}{ending}, else the only file with that ending, else null.

    A file ends in at most a few of the endings, so each is listed once per match.
    """
    stem = F.regexp_extract("folder", r"([^/]*)$", 1)
    hits = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), F.lit(s).alias("ending")) for k, s in SUFFIXES.items()]),
        lambda e: F.endswith(F.col("name"), e["ending"]),
    )
    f = listing.select("folder", "name", "path", F.explode(hits).alias("_e"))
    f = f.withColumn("_exact", F.col("name") == F.concat(stem, F.col("_e.ending")))
    per = f.groupBy("folder", F.col("_e.key").alias("key")).agg(
        F.max(F.when(F.col("_exact"), F.col("path"))).alias("exact"), F.count("*").alias("n"), F.min("path").alias("any")
    )
    pick = F.coalesce(F.col("exact"), F.when(F.col("n") == 1, F.col("any")))
    wide = per.groupBy("folder").agg(*[F.max(F.when(F.col("key") == k, pick)).alias(k) for k in SUFFIXES])
    return listing.select("folder").distinct().join(wide, "folder", "left").select("folder", stem.alias("stem"), *SUFFIXES)


def step_preconditions(found: DataFrame) -> DataFrame:
    """(folder, step, ok, reason) for the five calibration steps."""
    have = {k: F.col(k).isNotNull() for k in SUFFIXES}
    image = have["original"] | have["ext_rm"]
    steps = {
        "monai": (have["original"] & have["brain_mask"], "needs original + brain_mask"),
        "bg": (image & have["brain_mask"] & have["ground_truth"], "needs original or ExtRm + brain_mask + GROUND_TRUTH"),
        "sigma": (
            image & have["brain_mask"] & have["ground_truth"] & have["no_bg"],
            "needs original or ExtRm + brain_mask + GROUND_TRUTH + NoBG",
        ),
        "cellprob": (have["ext_rm"] & have["ground_truth"], "needs ExtRm + GROUND_TRUTH"),
        "branch_radius": (have["ground_truth"], "needs GROUND_TRUTH"),
    }
    rows = F.array(
        *[F.struct(F.lit(s).alias("step"), ok.alias("ok"), F.lit(why).alias("reason")) for s, (ok, why) in steps.items()]
    )
    return found.select("folder", F.explode(rows).alias("_s")).select("folder", "_s.*")


def discovery_report(found: DataFrame) -> DataFrame:
    """(folder, key, found, line) in text form."""
    rows = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(s).alias("ending"), F.col(k).isNotNull().alias("found")) for k, s in SUFFIXES.items()]
    )
    r = found.select("folder", "stem", F.explode(rows).alias("_r")).select("folder", "stem", "_r.*")
    mark = F.when(F.col("found"), F.lit("found")).otherwise(F.lit("missing"))
    return r.withColumn("line", F.format_string("  [%7s] %-20s (%s%s)", mark, "key", "stem", "ending")).drop("ending")


def gt_samples(listing: DataFrame, ending: str) -> DataFrame:
    """Folders holding a file with this ending; hidden folders are skipped."""
    hidden = F.startswith(F.regexp_extract("folder", r"([^/]*)$", 1), F.lit("."))
    return listing.filter(F.endswith("name", F.lit(ending)) & ~hidden).select("folder").distinct()


def crop_pairs(listing: DataFrame) -> DataFrame:
    """Crop image + mask pairs by name: {xy|xz|yz}_slice_crop.tif with ..._masks.tif in the same folder."""
    f = listing.filter(F.endswith("name", F.lit(".tif")))
    masks = f.withColumn("stem", F.regexp_extract("name", r"^((?:xy|xz|yz)_\d+_\d+)_masks\.tif$", 1)).filter("stem <> ''")
    images = f.withColumn("stem", F.regexp_extract("name", r"^((?:xy|xz|yz)_\d+_\d+)\.tif$", 1)).filter("stem <> ''")
    part = [F.regexp_extract("stem", r"^(..)_(\d+)_(\d+)$", i) for i in (1, 2, 3)]
    return masks.select("folder", "stem", F.col("path").alias("mask_path")).join(
        images.select("folder", "stem", F.col("path").alias("image_path")), ["folder", "stem"]
    ).withColumns({"orientation": part[0], "slice_idx": part[1].cast("int"), "crop_no": part[2].cast("int")})


def route(listing: DataFrame) -> DataFrame:
    """Processing route per folder from its artefacts: fragments, labelling, both or none."""
    found = discover_files(listing)
    a, b = F.col("ext_rm").isNotNull(), F.col("no_bg").isNotNull()
    r = F.when(a & b, "both").when(a, "fragments").when(b, "labelling").otherwise("none")
    return found.select("folder", r.alias("route"))


def artefact_name(kind: str, mode: int = 0) -> str:
    """Artefact name of a brain-only table for a background mode (0 off .. 3 random fill)."""
    return kind + MODE_SUFFIX[mode] if kind == "brain_only" else kind
