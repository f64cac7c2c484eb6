import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowtide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", app="flowtide-tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def slices(spark):
    """Sets the number of slices that ordered scans cut the rows into."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)
