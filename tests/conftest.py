import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from pageloom.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, spark__sql__shuffle__partitions="4")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


def values(df, *cols):
    """Rows of the named columns as a sorted list of tuples (or of values for one column)."""
    rows = df.select(*cols).collect() if cols else df.collect()
    out = [r[0] if len(r) == 1 else tuple(r) for r in rows]
    return sorted(out, key=repr)
