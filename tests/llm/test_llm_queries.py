"""Queries of this subpackage against their SQL on the smallest tables."""

import os

import pytest

from tests.test_queries import SF, same
from tributary.llm import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, name):
    same(spark, name, registry.QUERIES[name], registry.ORACLE[name])
