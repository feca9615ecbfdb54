"""The registered queries, and for each the SQL that must give the same rows."""

QUERIES = {}
ORACLES = {}


def query(sql=None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register
