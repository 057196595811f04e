from __future__ import annotations

import pytest

from versemill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="8g")
    session.sparkContext.setLogLevel("OFF")
    yield session


def rows(df, *columns):
    """Sorted tuples of a small result."""
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())
