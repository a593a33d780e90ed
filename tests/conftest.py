import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from basketry.session import local_session
    s = local_session(4, 8, app="basketry-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def shop(spark):
    from basketry.sources.fixture import load
    return load(spark, SF_SMALL)
