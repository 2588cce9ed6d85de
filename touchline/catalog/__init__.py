"""Every operator as a named query over the test tables, with its oracle SQL."""

from touchline.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
from touchline.catalog import values  # noqa: E402,F401
from touchline.catalog import history  # noqa: E402,F401
from touchline.catalog import evaluation  # noqa: E402,F401
from touchline.catalog import listing  # noqa: E402,F401
from touchline.catalog import splits  # noqa: E402,F401
from touchline.catalog import ingest  # noqa: E402,F401
from touchline.catalog import models  # noqa: E402,F401
from touchline.catalog import streaming  # noqa: E402,F401
