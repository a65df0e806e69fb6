import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from indicata.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="indicata-tests", shuffle_partitions=4)
    yield s
    s.stop()


# FIXTURES.md section 3: the literal edge-case table.
EDGE_ROWS = [
    (1, "A", 2000, "I.1", "Tax", 1.0, "S1", "C1", "North East"),
    (2, "A", 2001, "I.1", "Tax", 2.0, "S1", "C1", "North East"),
    (3, "A", 2001, "I.1", "Tax", 9.0, "S1", "C1", "North East"),
    (4, "B", 2000, "I.1", "Tax", None, "S1", "C1", "North East"),
    (5, "B", 2003, "I.1", "Tax", 4.0, "S1", "C1", "North East"),
    (6, "C", 2000, "I.1", "Tax", 8.0, "S2", "C2", "South"),
    (7, None, 2000, "I.1", "Tax", 3.0, "S1", "C1", "North East"),
    (8, "C", 2000, "I.2", "Debt", None, "S1", "C1", "South"),
    (9, "C", 2001, "I.2", "Debt", None, "S1", "C1", "South"),
    (10, "D", 2000, None, None, 5.0, "S1", "C1", None),
    (11, "D", 2001, "I.3", "Aid", 7.0, "S2", "C2", None),
    (12, "A", 2000, "I.3", "Aid", 6.0, "S2", "C2", "North East"),
]
EDGE_SCHEMA = ("seq int, country string, year int, indicator_code string, indicator_label string, "
               "value double, source string, collection string, sub_region_name string")


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)
