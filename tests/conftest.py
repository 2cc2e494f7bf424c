import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from evidlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    yield s


@pytest.fixture(scope="session")
def day():
    """Timestamps by the number of the day."""
    return lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
