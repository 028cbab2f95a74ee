"""All queries over the item tables, each with its SQL."""

from __future__ import annotations

from functools import wraps


def _shipped(f):
    """The query with the package sent to the executors first."""
    from inventa.sources.shared import ship

    @wraps(f)
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    from inventa.plans import more, pixels, regions  # noqa: F401
    from inventa.plans.queries import QUERIES

    return {name: _shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from inventa.plans import more, pixels, regions  # noqa: F401
    from inventa.plans.queries import SQL

    return dict(SQL)
