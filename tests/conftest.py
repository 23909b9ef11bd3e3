import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from segloom.session import local_session, ship

    s = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4"})
    ship(s)
    yield s
    s.stop()


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def collected():
    return rows
