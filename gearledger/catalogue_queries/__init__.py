"""Registered queries over the given tables, each beside the SQL that must give the same rows.

The tables are turned into catalogue shapes by portable SQL text (``shapes``) that both engines run; the work
itself is written twice, with the library on one side and as plain SQL on the other.
"""

from importlib import import_module

AREAS = ("prices", "builds", "catalogue", "ingestion", "discovery", "specs", "quality", "files")


def registered() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all areas."""
    queries: dict = {}
    oracles: dict = {}
    for area in AREAS:
        module = import_module(f"{__name__}.{area}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
