import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from slicegauge.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[8]", 8, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def local_frame(spark, rows, schema):
    """Rows as a local relation of known size (a list alone has no size estimate)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    struct = spark.createDataFrame([], schema).schema
    table = pa.Table.from_pylist([dict(zip(struct.names, r)) for r in rows], schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, struct)
