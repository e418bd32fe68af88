"""Volume tables, scanner metadata and stage tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scalar import anisotropy
from ..joins import spread_join
from ..schemas import KEYS, VOLUMES, VOXELS
from ..session import materialize


def read_voxels(spark: SparkSession, path: str, volumes_path: str | None = None) -> DataFrame:
    """Voxel rows (partitioned by fish_id, channel) with scale and shape attached when given."""
    v = spark.read.schema(VOXELS).parquet(path)
    if volumes_path is None:
        return v
    dims = spark.read.schema(VOLUMES).parquet(volumes_path)
    return v.join(dims, ["fish_id", "channel"])


def write_voxels(voxels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    voxels.repartition("fish_id", "channel", F.floor(F.col("z") / 16)).write.mode(mode).partitionBy("fish_id", "channel").parquet(path)


def channel_names(volumes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Layer name per channel: the stem, or stem_ch{c} when a sample has several channels."""
    n = volumes.groupBy(*keys).agg(F.countDistinct("channel").alias("_n"))
    name = F.when(F.col("_n") > 1, F.concat(F.col("fish_id"), F.lit("_ch"), F.col("channel").cast("string")))
    return volumes.join(n, list(keys)).withColumn("layer", F.coalesce(name, "fish_id")).drop("_n")


def select_channel(voxels: DataFrame, channel: int) -> DataFrame:
    return voxels.filter(F.col("channel") == channel)


# fixed values: how the scanner's text file names each quantity
NUMBER = r"(\d+\.?\d*)"
WIDTH = r"\{DisplayName=Pixel Width \(µm\), Value=" + NUMBER + r"\}"
HEIGHT = r"\{DisplayName=Pixel Height \(µm\), Value=" + NUMBER + r"\}"
STEP = r"StepSize=" + NUMBER
MAGNIFICATION = r"\{DisplayName=TotalConsolidatedOpticalMagnification, Value=" + NUMBER + r"\}"


def parse_metadata(texts: DataFrame) -> DataFrame:
    """Voxel size per text file; files missing a value give no row."""

    def first(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).cast("double")

    mags = F.transform(F.regexp_extract_all("value", F.lit(MAGNIFICATION), F.lit(1)), lambda m: m.cast("double"))
    t = texts.select(
        "path", first(WIDTH).alias("_w"), first(HEIGHT).alias("_h"), first(STEP).alias("voxel_z_um"), mags.alias("_m")
    )
    t = t.withColumn("_total", F.get(F.filter("_m", lambda m: m >= 10), F.lit(0)) * F.get(F.filter("_m", lambda m: m < 10), F.lit(0)))
    t = t.filter("_w is not null and _h is not null and voxel_z_um is not null and _total is not null")
    t = t.withColumn("voxel_y_um", F.col("_h") / F.col("_total")).withColumn("voxel_x_um", F.col("_w") / F.col("_total"))
    return t.select(
        "path", "voxel_z_um", "voxel_y_um", "voxel_x_um", anisotropy("voxel_z_um", "voxel_y_um", "voxel_x_um").alias("anisotropy")
    )


def read_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    t = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_metadata(t)


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names (2 x matching characters / total), as Python's difflib gives it."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(a, b)])


# Marked so that the optimizer does not run it again inside a pushed-down filter.
text_ratio = text_ratio.asNondeterministic()


def _letters(name: str) -> Column:
    """How many characters of a name fall in each of 16 hash classes."""
    chars = F.filter(F.split(F.lower(name), ""), lambda c: c != "")
    kind = F.transform(chars, lambda c: F.pmod(F.hash(c), F.lit(16)))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.size(F.filter(kind, lambda v: v == k)))


def match_metadata(images: DataFrame, metas: DataFrame, floor: float = 0.3) -> DataFrame:
    """The metadata file of each image: {stem}_metadata in its folder, else the most similar sibling above ``floor``.

    ``images``: folder, stem; ``metas``: folder, meta_stem (without the
    ``_metadata`` ending). Exact matches are settled by an equi-join. For the
    rest, shared letters bound the similarity from above; the full comparison
    runs on the best-bounded name first, then only on names whose bound can
    still beat or tie it.
    """
    metas = metas.select("folder", "meta_stem").distinct()
    exact = images.join(metas.withColumn("stem", F.col("meta_stem")), ["folder", "stem"]).select(
        "folder", "stem", "meta_stem", F.lit(1.0).alias("ratio"), F.lit(True).alias("exact")
    )
    open_ = images.join(exact, ["folder", "stem"], "left_anti").select("folder", "stem").distinct()
    a = materialize(open_.select("folder", "stem", _letters("stem").alias("_a")), "names")
    b = materialize(metas.select("folder", "meta_stem", _letters("meta_stem").alias("_b")), "names")
    # The name lists are small but their pairs are many: spread the left side before it multiplies.
    a = a.repartition(2 * images.sparkSession.sparkContext.defaultParallelism, "folder", "stem")
    duo = spread_join(a, b, ["folder"], ["stem"])
    shared = F.aggregate(F.zip_with("_a", "_b", lambda p, q: F.least(p, q)), F.lit(0), lambda acc, v: acc + v)
    bound = shared * 2.0 / (F.length("stem") + F.length("meta_stem"))
    duo = materialize(duo.select("folder", "stem", "meta_stem", bound.alias("_bound")).filter(F.col("_bound") > floor), "bounds")
    first = duo.groupBy("folder", "stem").agg(F.max_by("meta_stem", F.struct("_bound", "meta_stem")).alias("_m"))
    reach = first.select("folder", "stem", text_ratio(F.lower("stem"), F.lower("_m")).alias("_reach"))
    reach = materialize(reach, "reach")
    duo = duo.join(reach, ["folder", "stem"]).filter(F.col("_bound") >= F.col("_reach") - 1e-12)
    duo = duo.repartition(2 * images.sparkSession.sparkContext.defaultParallelism, "folder", "stem")
    duo = duo.withColumn("ratio", text_ratio(F.lower("stem"), F.lower("meta_stem"))).filter(F.col("ratio") > floor)
    best = duo.groupBy("folder", "stem").agg(F.min_by(F.struct("meta_stem", "ratio"), F.struct(-F.col("ratio"), "meta_stem")).alias("_b"))
    return exact.unionByName(best.select("folder", "stem", "_b.meta_stem", "_b.ratio", F.lit(False).alias("exact")))


def resolve_scale(images: DataFrame, external: DataFrame, embedded: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """Scale by priority: external text, embedded tags, 1/1/1. Both sides hold sz, sy, sx."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*on, F.struct("sz", "sy", "sx", F.lit(name).alias("source")).alias(f"_{name}"))

    none = F.struct(*[F.lit(1.0).alias(c) for c in ("sz", "sy", "sx")], F.lit("default").alias("source"))
    out = images.join(side(external, "external"), list(on), "left").join(side(embedded, "embedded"), list(on), "left")
    out = out.withColumn("_s", F.coalesce("_external", "_embedded", none)).drop("_external", "_embedded")
    out = out.select(*[c for c in out.columns if c != "_s"], "_s.*")
    return out.withColumn("anisotropy", anisotropy("sz", "sy", "sx"))


def fingerprints_match(a: dict, b: dict) -> bool:
    """Equal in every entry; floats within 1e-8 + 1e-5 |b|."""
    if a.keys() != b.keys():
        return False
    for k, v in a.items():
        w = b[k]
        if isinstance(v, float) or isinstance(w, float):
            if not abs(v - w) <= 1e-8 + 1e-5 * abs(w):
                return False
        elif v != w:
            return False
    return True


def cached_stage(spark: SparkSession, path: str, fingerprint: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a stage table if one with a matching fingerprint lies under ``path``; otherwise build and write it.

    Each build gets its own folder; the fingerprint row is written last, so an
    interrupted build is never read.
    """
    import json
    import uuid

    from pyspark.errors import AnalysisException

    index = f"{path}/_index"
    try:
        entries = spark.read.schema("folder string, fingerprint string").json(index).collect()  # one row per build
    except AnalysisException:
        entries = []
    for e in entries:
        if fingerprints_match(fingerprint, json.loads(e["fingerprint"])):
            return spark.read.parquet(f"{path}/{e['folder']}")
    folder = uuid.uuid4().hex
    build().write.parquet(f"{path}/{folder}")
    entry = spark.createDataFrame([(folder, json.dumps(fingerprint))], "folder string, fingerprint string")
    entry.write.mode("append").json(index)
    return spark.read.parquet(f"{path}/{folder}")


def write_polygons(polygons: DataFrame, path: str, mode: str = "overwrite") -> None:
    polygons.select("fish_id", "z", "pts").write.mode(mode).parquet(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    from ..schemas import POLYGONS

    return spark.read.schema(POLYGONS).parquet(path)


def write_pointer(checkpoints: DataFrame, requests: DataFrame, path: str) -> DataFrame:
    """Write (model, target) for requested best epochs; raises if a target checkpoint does not exist.

    ``requests``: model, epoch; ``checkpoints``: name. Returns the pointer rows.
    """
    target = F.format_string("%s_epoch_%04d", "model", "epoch").alias("target")
    want = requests.select("model", target)
    lost = want.join(checkpoints.select(F.col("name").alias("target")), "target", "left_anti")
    if lost.take(1):
        raise FileNotFoundError("best checkpoint not found")
    want.write.mode("overwrite").parquet(path)
    return want


def resolve_pointers(pointers: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Pointers whose checkpoint still exists."""
    return pointers.join(checkpoints.select(F.col("name").alias("target")), "target", "left_semi")
