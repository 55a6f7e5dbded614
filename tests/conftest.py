import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from halyard.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="halyard-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def demo(spark):
    from tests.demo_rows import demo_tables
    return demo_tables(spark)
