"""Text columns: rule-based sentence and prompt per object."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# fixed value: prompt layout filled per row
PROMPT = (
    "You are analyzing a single 3D cell from a zebrafish brain confocal microscopy image.\n"
    "Given the morphological statistics below, write ONE concise sentence (max 40 words) "
    "describing the cell's shape, size, and notable features.\n\n"
    "Label: %d\n"
    "Volume: %.0f µm³\n"
    "Elongation (longest/shortest axis): %.2f\n"
    "Dominant axis: %s\n"
    "Sphericity (1=sphere): %.3f\n"
    "Solidity (1=convex): %.3f\n"
    "Branches: %d  Endpoints: %d  Mean branch length: %.1f µm\n"
    "Morphotype: %s\n"
    "Centroid: Z=%.1f Y=%.1f X=%.1f µm\n\n"
    "Description:"
)
PROMPT_COLUMNS = (
    "label", "volume_um3", "elongation", "principal_axis_dir", "sphericity", "solidity", "n_branches", "n_endpoints",
    "mean_branch_len_um", "morphotype", "centroid_z_um", "centroid_y_um", "centroid_x_um",
)


def _capital(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def describe() -> Column:
    """One sentence on shape, size, place, surface and branching."""
    spher, elong, solid = F.col("sphericity"), F.col("elongation"), F.col("solidity")
    n_br, n_ep, length = F.col("n_branches"), F.col("n_endpoints"), F.col("mean_branch_len_um")
    along = F.concat(F.lit("elongated along "), F.col("principal_axis_dir"), F.lit("-axis"))
    ratio = F.format_string(" (%.1f:1)", elong)
    shape = (
        F.when(spher > 0.85, F.lit("spherical"))
        .when((spher > 0.70) & (elong > 1.8), F.concat(F.lit("rounded, "), along, ratio))
        .when(spher > 0.70, F.lit("rounded"))
        .when(elong > 2.5, F.concat(along, ratio))
        .when(elong > 1.5, F.concat(F.lit("moderately "), along))
        .otherwise(F.lit("compact, irregular"))
    )
    skin = (
        F.when(solid > 0.90, F.lit("smooth surface"))
        .when(solid > 0.75, F.lit("slightly lobulated surface"))
        .otherwise(F.lit("lobulated/irregular surface"))
    )
    mean = F.when(length > 0, F.format_string(" (mean %.1f µm)", length)).otherwise(F.lit(""))
    arms = (
        F.when(n_br == 0, F.lit("no branching detected"))
        .when(n_br <= 2, F.concat(F.format_string("%d protrusion(s)", n_ep), mean))
        .otherwise(F.concat(F.format_string("%d branches, %d endpoints", n_br, n_ep), mean))
    )
    kind = F.when(F.col("morphotype") != "", F.format_string(" Morphotype: %s.", F.col("morphotype"))).otherwise(F.lit(""))
    return F.concat(
        F.format_string("Label %d: ", F.col("label")),
        _capital(shape),
        F.format_string(", volume %,.0f µm³, centroid Z=%.1f Y=%.1f X=%.1f µm. ", "volume_um3", *[f"centroid_{c}_um" for c in "zyx"]),
        _capital(skin),
        F.format_string(", sphericity %.2f, solidity %.2f. ", spher, solid),
        _capital(arms),
        F.lit("."),
        kind,
    )


def describe_with(objs: DataFrame, fn: Column | Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Add ``description``: the rule by default, else a column or a function of the table giving one (e.g. a pandas UDF)."""
    text = describe() if fn is None else fn if isinstance(fn, Column) else fn(objs)
    return objs.withColumn("description", text)


def build_prompts(objs: DataFrame) -> DataFrame:
    return objs.withColumn("prompt", F.format_string(PROMPT, *PROMPT_COLUMNS))
