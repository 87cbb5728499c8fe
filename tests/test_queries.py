"""Queries of what is refused, written and checked against their SQL."""

import pytest

from tests.oracle import connect, difference
from tidelog.plans import checks

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(checks.SQL))
def test_checks(spark, name):
    assert difference(checks.QUERIES[name](spark, FOLDER), connect(FOLDER), checks.SQL[name]) == ""
