import pytest

from ledgerwake.plans.oracle import oracle_sql
from ledgerwake.plans.queries import queries

from .oracle import duck_rows, rows

SQL = oracle_sql()


def test_every_query_has_sql_but_the_trained_ones():
    assert set(queries()) - set(SQL) == {"gbt_oof_scores", "ensemble_oof_scores", "feature_importance", "importance_pruning", "pseudo_label_scores"}
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, name):
    assert rows(queries()[name](spark, small)) == duck_rows(SQL[name], small)
