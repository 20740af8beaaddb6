"""Names, Spark callables and oracle statements."""
from filingsift.catalog.views import VIEWS

QUERIES, ORACLES = {}, {}


def statement(tail, views=()):
    """Prefix a statement with the fixture views it reads. ``tail`` starts with select, or with a
    comma when it adds common table expressions of its own."""
    if not views:
        return tail.strip()
    ctes = ",\n".join(f"{v} as ({VIEWS[v]})" for v in views)
    return f"with {ctes}\n{tail.strip()}"


def query(name, sql=None, views=()):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = statement(sql, views)
        return fn
    return register
