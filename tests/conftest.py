from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from prorrata.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, shuffle_partitions=4)
    yield session
    session.stop()


def rows(df, *columns, order=None):
    """Rows as tuples, sorted unless they are already ordered."""
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return found if order else sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))
