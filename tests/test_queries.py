"""Every registered core query runs, and equals its DuckDB statement where it has one."""

import pytest

from tests.parity import DATA, HAVE_DATA, both
from tutorgrain.plans import catalog

pytestmark = pytest.mark.skipif(not HAVE_DATA, reason="no test data")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    got, want = both(spark, catalog.queries()[name], catalog.oracle_sql()[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() >= 0
