from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tilewright import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


RASTER = "image_id BIGINT, label STRING, h INT, w INT, ok BOOLEAN, red ARRAY<SMALLINT>, green ARRAY<SMALLINT>, blue ARRAY<SMALLINT>"


def picture(rows, low=10, high=200):
    """Grey levels from a drawing: # is bright."""
    return [[high if ch == "#" else low for ch in row] for row in rows]


@pytest.fixture(scope="session")
def rasters(spark):
    """Factory: list of (green, red) row lists, or None for an unreadable file."""

    def make(images):
        rows = []
        for i, image in enumerate(images):
            if image is None:
                rows.append((i, str(i % 2), 0, 0, False, None, None, None))
                continue
            green, red = image
            flat = lambda grid: [int(v) for row in grid for v in row]
            rows.append((i, str(i % 2), len(green), len(green[0]), True, flat(red), flat(green), [0] * (len(green) * len(green[0]))))
        return spark.createDataFrame(rows, RASTER)

    return make
