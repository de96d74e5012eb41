"""The registered corpus queries and their SQL."""

QUERIES = {}
ORACLES = {}


def register(name, sql=None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add
