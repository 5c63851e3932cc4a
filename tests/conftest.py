import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from rankflow.session import build_session
    ckpt = tempfile.mkdtemp(prefix="rankflow-test-ckpt-")
    s = build_session("local[4]", 4, app_name="rankflow-tests",
                      extra={"spark.checkpoint.dir": ckpt, "spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()
