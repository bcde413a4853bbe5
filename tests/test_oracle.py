"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

from cueloom.plans.queries import ORACLE, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLE[name], SF)
