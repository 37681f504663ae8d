import pytest

from tests.compare import by_sql, rows


def names():
    from cairn.plans import details, features  # noqa: F401
    from cairn.plans.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query_agrees_with_sql(spark, sf, name):
    from cairn.plans.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0
    if name in ORACLE_SQL:
        want = by_sql(ORACLE_SQL[name], sf)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_push_down_and_prune(spark, sf):
    from cairn.sources import views

    plan = views.solves(spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "p_type" in plan
    assert "p_retailprice" not in plan.split("ReadSchema")[-1]
