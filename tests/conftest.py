from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hazegrid.session import build_session, release  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session("hazegrid-tests", 8, partitions=4, shared=str(shared))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    assert not list((shared / "hazegrid").glob("*")), "written tables are left in the shared folder"
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def duck(folder):
    from compare import connect

    return connect(folder)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()
