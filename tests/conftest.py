from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from moodframe.session import local_session
    s = local_session("*", shuffle_partitions=8, app="moodframe-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_check():
    from harness import duck
    return duck(SF_CHECK)
