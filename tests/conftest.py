import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from inkloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session


@pytest.fixture(scope="session")
def raster(spark):
    """Builds a pixel table from ``{image_id: (w, h, colour function)}``."""
    def build(images: dict):
        rows = [
            (i, x, y, w, h, *(paint(x, y) + (255,))[:4])
            for i, (w, h, paint) in images.items() for y in range(h) for x in range(w)
        ]
        return spark.createDataFrame(
            rows, "image_id long, x long, y long, w long, h long, r long, g long, b long, a long")

    return build


@pytest.fixture(scope="session")
def labels(spark):
    """Builds a label table from ``{image_id: list of strings}``, one character per pixel."""
    def build(images: dict):
        rows = [
            (i, x, y, len(lines[0]), len(lines), ord(ch))
            for i, lines in images.items() for y, line in enumerate(lines)
            for x, ch in enumerate(line)
        ]
        return spark.createDataFrame(
            rows, "image_id long, x long, y long, w long, h long, slot long")

    return build
