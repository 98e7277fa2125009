"""Checked queries over the test tables."""


def load_all():
    """Every registered query and SQL twin."""
    from checks import blocks, clinical, clusters, relational, scalars, statistics  # noqa: F401
    from checks.registry import QUERIES, oracle_sql

    return QUERIES, oracle_sql()
