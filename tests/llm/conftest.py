import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from compare import connect  # noqa: E402,F401
from llm_helpers import DOCS, edge_rows, local_frame  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return local_frame(spark, edge_rows(), DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return local_frame(spark, [], DOCS)
