import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lotlens.session import get_spark
    # Tests own their shared folder: set it only because it is unset here.
    ckpt = tempfile.mkdtemp(prefix="lotlens-test-")
    s = get_spark("local[4]", 8, extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()
