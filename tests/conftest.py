import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from modelwarden.session import local_session

    session = local_session(cores=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as plain tuples, sorted."""

    def collect(df, *columns):
        df = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
