import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from archivesearch.session import ensure_checkpoint_dir, get_spark
    s = get_spark("local[4]", app="archivesearch-tests", shuffle_partitions=4)
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="as-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
