import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from vatlens.session import get_session
    with tempfile.TemporaryDirectory(prefix="vatlens-test-") as folder:
        s = get_session("local[4]", shuffle_partitions=8, extra={
            "spark.checkpoint.dir": f"file://{folder}/checkpoints", "spark.sql.warehouse.dir": f"file://{folder}/warehouse"})
        yield s
        s.stop()


@pytest.fixture()
def tmpdir_spark(tmp_path):
    return str(tmp_path)
