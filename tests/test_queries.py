"""Every bound query against its SQL twin on the smallest tables, and row-order independence of a few."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.sidebyside import compare, duck, plain


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_same_rows_as_sql(spark, con, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, SMALL).columns
        return
    assert compare(spark, con, entry.queries()[name], sql, SMALL) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_shuffled_input_gives_the_same_sample(spark):
    from loomtrace.operators import sampling
    from loomtrace.sources import views

    rows = views.feature_rows(spark, SMALL).where("parse")
    pick = lambda frame: sorted(map(plain, sampling.tail_sample(frame, 20, 10).select("key", "selection_reasons").collect()))
    assert pick(rows) == pick(rows.repartition(7, "model"))
