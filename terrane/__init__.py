"""Terrane: landscape analytics over ensembles of ordered vectors, on Spark DataFrames."""

from __future__ import annotations

import os


def on_workers(spark) -> None:
    """Let Python workers import this package from where the driver has it, if they see that folder and nothing else put it on their path.

    Also turns off that a union keeps its inputs' partitioning: in Spark 4.1.2 an aggregation or window by the partition key behind a union of
    coalesced and reused shuffles misses or splits groups.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)
