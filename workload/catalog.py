"""All registered queries."""

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusgraph.functions.ordered import first_rows
from corpusgraph.functions.tables import tune

from . import (q_batches, q_export, q_extract, q_graph, q_inventory, q_refresh, q_reports,  # noqa: F401
               q_scan, q_tags)
from .registry import QUERIES, twins  # noqa: F401


def _tuned(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        return fn(tune(spark), sf_dir)
    return run


def queries():
    return {name: _tuned(fn) for name, fn in QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten most called functions of each repository: scan, extract, resolve calls, rank."""
    called = q_graph.most_called(tune(spark), sf_dir)
    return first_rows(called, ["repo_id"], [F.desc("callers"), F.col("function")], 10)
