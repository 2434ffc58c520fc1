"""Every query that SQL can express gives DuckDB's rows."""

import pytest

from signalloom import catalog

from .compare import connect, duck_rows, spark_rows


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, sf_dir, db, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert spark_rows(df) == duck_rows(db, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"gbt_scores"}))
def test_others_run(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_names_have_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
