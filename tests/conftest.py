import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from oracle_check import session
    s = session()
    s.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    yield s
    s.stop()
