"""Every registered query against its DuckDB counterpart: names, types, rows and values."""

import __spark_entry__ as entry
import pytest
from compare import connect, difference
from sqlloom.plans import oracle, registry

QUERIES, ORACLE = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: Fitted weights cannot be expressed in SQL; test_item_ranker.py holds the scores against a plain sum over features.
TRAINED = {"top_k_columns_trained"}


def test_every_query_has_a_counterpart():
    assert QUERIES.keys() == ORACLE.keys() | TRAINED and not TRAINED & ORACLE.keys()


@pytest.mark.parametrize("name", ORACLE)
def test_query(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["question_id", "text", "labels"]
