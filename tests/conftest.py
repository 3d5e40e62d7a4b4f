from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terrasig.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build(shuffle_partitions=4, app="tests")
    yield s
    s.stop()


@pytest.fixture
def out_dir():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
