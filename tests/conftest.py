import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracelathe.session import build_session  # noqa: E402

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines_of(spark):
    def make(*texts, test_id="t"):
        rows = [(test_id, i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "test_id string, line_id long, raw string")
    return make


@pytest.fixture(scope="session")
def access_of(spark):
    """Access rows from (test_id, ts, action letter, descr, value)."""
    from tracelathe.operators.parse import parse_access

    def make(rows):
        raw = [(t, i, f"[{ts}] MEM_{a} [0x{i:x}] 32b {d} 0x{v:x}") for i, (t, ts, a, d, v) in enumerate(rows)]
        return parse_access(spark.createDataFrame(raw, "test_id string, line_id long, raw string"))
    return make
