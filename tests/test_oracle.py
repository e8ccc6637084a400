import pytest

from palimpsest.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import SF, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["version_changes", "question_plans", "greedy_match", "orphan_refs", "semantic_norm", "nw_align"])
def test_other_queries_return_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.entry(spark).columns) == {"pair_id", "unchanged", "replaced", "deleted", "added"}
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
