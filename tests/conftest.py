from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from workbench.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def rows():
    """Rows of a DataFrame as dicts."""
    return lambda df: [row.asDict(recursive=True) for row in df.collect()]


@pytest.fixture
def one(rows):
    """The single row of a DataFrame."""

    def single(df):
        found = rows(df)
        assert len(found) == 1, found
        return found[0]

    return single
