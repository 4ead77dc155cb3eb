import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from corpusterms.session import local_session

    s = local_session("4", shuffle_partitions=8, app="corpusterms-tests")
    yield s
    s.stop()


@pytest.fixture
def corpus(spark):
    """Build a corpus DataFrame (document string, text string) from pairs."""

    def make(*pairs):
        return spark.createDataFrame(list(pairs), "document string, text string")

    return make
