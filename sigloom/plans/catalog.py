"""The catalogue of runnable queries: a name, a function of (session, table folder), and SQL for the same result."""

_QUERIES, _SQL = {}, {}


def query(name, sql=None):
    """Register ``function(spark, sf_dir) -> DataFrame``; ``sql`` computes the same rows on the same tables."""
    def register(function):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function
    return register


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _load():
    from sigloom.plans import queries_sequences, queries_taxonomy, queries_trees, queries_vectors  # noqa: F401


def all_queries():
    _load()
    return dict(_QUERIES)


def all_sql():
    _load()
    return dict(_SQL)
