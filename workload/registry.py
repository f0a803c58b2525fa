"""Registered queries and their SQL twins."""

from .sqlbook import sql

QUERIES, TWINS = {}, {}


def query(name: str, twin: str = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with an optional SQL twin."""
    def add(fn):
        QUERIES[name] = fn
        if twin:
            TWINS[name] = twin
        return fn
    return add


def twins() -> dict:
    return {name: sql(text) for name, text in TWINS.items()}
