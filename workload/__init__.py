"""The operators bound to the test tables: one query per operator, with equivalent SQL where possible."""

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load_all() -> None:
    from workload import discovery, landing, matching, normalizing, ranking, streams, structuring, texts  # noqa: F401
