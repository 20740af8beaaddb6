"""Registered queries: each operator on the given tables, with an equivalent SQL statement where SQL
can say the same."""
from filingsift.catalog.registry import ORACLES, QUERIES

_loaded = False


def load():
    global _loaded
    if not _loaded:
        from filingsift.catalog import (cleaning, evaluation, features, joining, reports, sections,  # noqa: F401
                                        sketches, sources, splitting, states)
        _loaded = True
    return QUERIES, ORACLES
