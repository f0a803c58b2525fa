"""Queries of this subpackage and their SQL twins."""

import functools

from pyspark.sql import SparkSession

from corpusgraph.functions.tables import tune

QUERIES, TWINS = {}, {}


def ready(spark: SparkSession) -> SparkSession:
    """Session settings, and this package sent to the executors' Python once per application."""
    return tune(spark)


def query(name: str, twin: str = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with an optional SQL twin."""
    def add(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            return fn(ready(spark), sf_dir)
        QUERIES[name] = run
        if twin:
            TWINS[name] = twin
        return fn
    return add
