import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from airzone.session import local_session

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    path = TESTDATA / "sf0.001"
    if not path.exists():
        pytest.skip("test tables are not here")
    return str(path)


def rows(df, *columns):
    """Sorted plain tuples of a result."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


@pytest.fixture(name="rows")
def rows_fixture():
    return rows


@pytest.fixture
def no_broadcast(spark):
    """A call of it makes Catalyst plan every join without a broadcast until the test ends."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    yield lambda: [spark.conf.set(n, "-1") for n in names]
    for n in names:
        spark.conf.unset(n)
