import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
