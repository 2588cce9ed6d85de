import sys
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from checker import SF  # noqa: E402

from touchline.schema import MATCH  # noqa: E402
from touchline.session import local_session  # noqa: E402
from touchline.sources.fixtures import derive  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def tables(spark):
    return derive(spark, SF)


@pytest.fixture
def make_matches(spark):
    """Rows as (home, away, home score, away score[, date]) to a finished match table."""

    def make(rows, status="FINISHED"):
        full = []
        for i, row in enumerate(rows, 1):
            home, away, hs, as_, *date = row
            full.append((i, 1, 1, home, away, date[0] if date else datetime(2025, 1, 1), status if hs is not None else "SCHEDULED",
                         hs, as_, None, None, None, None))
        return spark.createDataFrame(full, MATCH)

    return make
