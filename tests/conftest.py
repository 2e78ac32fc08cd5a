from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fieldglass.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="6g", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("tables"))
