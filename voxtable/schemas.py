"""Table schemas. Every table starts with the sample key ``fish_id``."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("fish_id",)
ZYX = ("z", "y", "x")

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


_ZYX = dict(z=_I, y=_I, x=_I)

VOXELS = _struct(fish_id=_S, channel=_I, **_ZYX, value=_D)
VOLUMES = _struct(fish_id=_S, channel=_I, nz=_I, ny=_I, nx=_I, sz=_D, sy=_D, sx=_D, anisotropy=_D, source=_S)
MASKS = _struct(fish_id=_S, mask_name=_S, **_ZYX)
PROBS = _struct(fish_id=_S, map_name=_S, **_ZYX, p=_D)
LABELS = _struct(fish_id=_S, label_set=_S, **_ZYX, label=_I)
BOUNDARIES = _struct(fish_id=_S, line_no=_I, seq=_I, y_um=_D, x_um=_D)
POINT = _struct(y=_D, x=_D)
POLYGONS = _struct(fish_id=_S, z=_I, pts=T.ArrayType(POINT))
REGION_NAMES = _struct(fish_id=_S, names=T.ArrayType(_S))
GRID = _struct(p1=_D, p2=_D)
GT_HISTORY = _struct(config_key=_S, fish_id=_S, value=_D, verified=_B, ts=T.TimestampType())
MERGE_SAMPLES = _struct(fish_id=_S, kind=_S, gap_um=_D, contact_vox=_I)
CROPS = _struct(fish_id=_S, orientation=_S, slice_idx=_I, crop_no=_I, top=_I, left=_I)
CROP_PIXELS = _struct(fish_id=_S, orientation=_S, slice_idx=_I, crop_no=_I, y=_I, x=_I, value=_D, label=_I)
FILE_LISTING = _struct(path=_S, folder=_S, stem=_S, suffix=_S)
METADATA_TEXT = _struct(path=_S, value=_S)
METRIC_LOG = _struct(run_id=_S, ts=T.TimestampType(), seq=_L, line=_S)
MERGE_REQUESTS = _struct(fish_id=_S, label_set=_S, label_a=_I, label_b=_I)
SPLIT_REQUESTS = _struct(fish_id=_S, label_set=_S, label=_I, n_splits=_I, sigma=_D, min_distance=_I)


def field_types(df, names) -> T.StructType:
    """The fields of ``df`` called ``names``, in that order."""
    return T.StructType([df.schema[n] for n in names])
