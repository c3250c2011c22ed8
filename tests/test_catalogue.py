"""Every query against its DuckDB SQL over the smallest tables; the others run."""

import pytest
from oracle import difference

from assaykit.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, small, name):
    assert difference(catalogue.QUERIES[name](spark, small), catalogue.SQL[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0
