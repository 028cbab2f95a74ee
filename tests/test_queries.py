import pytest

from inventa.plans import more, pixels, regions  # noqa: F401
from inventa.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, duck, same, name):
    from inventa.plans.registry import queries

    same(queries()[name](spark, small), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    from inventa.plans.registry import queries

    assert queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_range_filter_reaches_the_scan(spark, small):
    plan = QUERIES["page_range_scan"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey,100)" in plan and "LessThanOrEqual(l_orderkey,400)" in plan


def test_lists_need_no_session():
    """The names of all queries and their SQL are there before Spark is."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 100, out.stderr[-500:]
