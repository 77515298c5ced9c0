"""Session settings the plans are written for.  Everything works without them, with a few more shuffles."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # runtime join choice by measured size, coalescing of small shuffle partitions, splitting of skewed ones
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # site-years are laid out by site; that layout also serves joins and windows on (site, measurement), (site, year)
    "spark.sql.requireAllClusterKeysForDistribution": "false",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


# Shuffles start with this many partitions per core of a cluster and are then coalesced by their measured size.
PARTITIONS_PER_CORE = 4
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    context = spark.sparkContext
    if spark.conf.get(INITIAL_PARTITIONS, None) is None and not context.master.startswith("local"):
        spark.conf.set(INITIAL_PARTITIONS, str(PARTITIONS_PER_CORE * context.defaultParallelism))
    return spark
