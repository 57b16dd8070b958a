"""Every query with SQL gives the SQL's rows; the others run with a stable schema."""

import pytest

import __spark_entry__ as entry
from conftest import DATA
from tagsmith.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(agree, name):
    assert agree(catalogue.QUERIES[name], catalogue.ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_scores(spark, name):
    rows = catalogue.QUERIES[name](spark, DATA).collect()
    assert rows and all(r.score is not None and r.score == r.score for r in rows)


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_id", "labels", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
