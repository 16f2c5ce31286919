import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from dwellkit import session

    session.DEFAULTS["spark.sql.warehouse.dir"] = str(tmp_path_factory.mktemp("warehouse"))
    s = session.local_session(cores=8, shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
