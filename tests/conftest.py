import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from voxtable.session import get_spark  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make(spark):
    """Label table from a dict fish -> dense int array."""

    def build(volumes, name="label"):
        rows = [
            (fish, int(z), int(y), int(x), int(dense[z, y, x]))
            for fish, dense in volumes.items()
            for z, y, x in zip(*np.nonzero(dense))
        ]
        return spark.createDataFrame(rows, f"fish_id string, z int, y int, x int, {name} int")

    return build


@pytest.fixture(scope="session")
def dims(spark):
    def build(volumes, scale=(1.0, 1.0, 1.0)):
        rows = [(f, 0, *map(int, d.shape), *map(float, scale), 1.0, "test") for f, d in volumes.items()]
        return spark.createDataFrame(
            rows, "fish_id string, channel int, nz int, ny int, nx int, sz double, sy double, sx double, anisotropy double, source string"
        )

    return build


def dense_of(df, shape, value="label"):
    """fish -> dense array from a voxel table."""
    out = {}
    for r in df.collect():
        d = out.setdefault(r["fish_id"], np.zeros(shape, dtype=int))
        d[r["z"], r["y"], r["x"]] = r[value] if value else 1
    return out
