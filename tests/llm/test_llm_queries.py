import os

import pytest

from support import SMALL, assert_matches_duckdb
from tapewright.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert_matches_duckdb(QUERIES[name], ORACLES[name], spark, SMALL)


def test_all_thirteen():
    assert [f"op{n}_" for n in range(1, 14)] == [k.split("_")[0] + "_" for k in QUERIES]
