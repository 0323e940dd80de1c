from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from devicelog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def folder():
    """A new folder per test; nothing is deleted."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def write_csv(folder):
    def write(name: str, text: str, sub: str = "in") -> str:
        target = os.path.join(folder, sub)
        os.makedirs(target, exist_ok=True)
        with open(os.path.join(target, name), "w", encoding="utf-8") as f:
            f.write(text)
        return target

    return write
