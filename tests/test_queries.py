import pytest

from echotrace.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(name, same):
    same(catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["event_id", "matched_id", "unique_senders", "verdict"]
