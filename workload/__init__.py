"""Registered queries over the given tables, with the SQL that must give the same rows."""


def registered():
    """``(queries, oracles)`` by name."""
    from workload import fixtures
    from workload import context, decide, enforce, ingest, measure, streamed, transform  # noqa: F401
    return fixtures.QUERIES, fixtures.ORACLES
