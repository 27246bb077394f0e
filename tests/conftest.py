import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpusflow.session import get_spark
    s = get_spark("local[*]", app="corpusflow-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(spark):
    from corpusflow.session import local_path, scratch_path
    return local_path(scratch_path(spark, "test"))
