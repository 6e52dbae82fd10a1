import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gabbro.session import local_session

    top = tempfile.mkdtemp(prefix="gabbro-test-")
    s = local_session(4, driver_memory="4g", **{"spark.sql.warehouse.dir": top, "spark.checkpoint.dir": f"{top}/ckpt"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
