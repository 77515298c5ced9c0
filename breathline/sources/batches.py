"""Annual statistics kept up to date: each batch of readings is condensed once, and only its years are worked out again.

A store is a folder with one folder of moments per batch, ``batch=<name>/year=<year>``.  A batch counts from the moment
Spark marks its folder as complete, so readers never see half of one, and a batch that failed, or is sent a second
time, is simply written again in its own folder: nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import exists, names_in
from ..operators.moments import merge_moments, moments, stats_of_moments
from ..rules import Rules

# Fixed value: what Spark leaves in a folder whose job has ended well.
COMPLETE = "_SUCCESS"


def _folder(store: str, batch: str) -> str:
    if not batch or not all(c.isalnum() or c in "-." for c in batch):
        raise ValueError(f"a batch is named by letters, digits, '-' and '.': {batch!r}")
    return f"{store.rstrip('/')}/batch={batch}"


def add_readings(readings: DataFrame, store: str, batch: str, rules: Rules) -> None:
    """Condense selected readings (``sources.select_readings``) and keep their moments as ``batch``.

    Only the new readings are read.  Sending a batch again replaces it.
    """
    state = moments(readings, rules)
    # a row per site and instrument: one file for each year
    state.repartition("year").write.mode("overwrite").partitionBy("year").parquet(_folder(store, batch))


def batches_in(spark: SparkSession, store: str) -> list[str]:
    """Names of the complete batches."""
    names = [n.removeprefix("batch=") for n in names_in(spark, store) if n.startswith("batch=")]
    return [n for n in names if exists(spark, f"{_folder(store, n)}/{COMPLETE}")]


def years_of(spark: SparkSession, store: str, batch: str) -> list[int]:
    """The years that a batch has readings of, from its folders alone."""
    return [int(n.removeprefix("year=")) for n in names_in(spark, _folder(store, batch)) if n.startswith("year=")]


def read_moments(spark: SparkSession, store: str, rules: Rules, years: list[int] | None = None) -> DataFrame:
    """Moments of all complete batches, merged; of some ``years`` only, whose folders alone are read then."""
    folders = [_folder(store, b) for b in batches_in(spark, store)]
    if not folders:
        raise ValueError(f"no complete batch in {store}")
    state = spark.read.option("basePath", store).parquet(*folders).drop("batch")
    if years is not None:
        state = state.where(F.col("year").isin(years))
    return merge_moments(state, rules=rules)


def read_annual(spark: SparkSession, store: str, rules: Rules, years: list[int] | None = None) -> DataFrame:
    """Annual statistics of everything in the store, as ``annual_site_stats`` of all its readings would be."""
    return stats_of_moments(read_moments(spark, store, rules, years), rules)


def refresh_annual(spark: SparkSession, store: str, table: str, batch: str, rules: Rules) -> list[int]:
    """Bring a folder of annual statistics by year up to date with a new batch; the years that were worked out again.

    Reads the moments of those years and replaces their folders, and no others (dynamic partition overwrite).  It can be
    repeated: what it writes depends on the store alone.
    """
    years = years_of(spark, store, batch)
    if years:
        annual = read_annual(spark, store, rules, years).repartition("year")
        annual.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(table)
    return years


def compact(spark: SparkSession, store: str, target: str, rules: Rules, batch: str = "all") -> None:
    """Write the whole store as a single batch of another store, for when there are many small ones.

    The old store stays as it is, so a failure loses nothing and nothing is ever in two batches of one store.
    """
    if store.rstrip("/") == target.rstrip("/"):
        raise ValueError("compact into another store")
    state = read_moments(spark, store, rules)
    state.repartition("year").write.mode("overwrite").partitionBy("year").parquet(_folder(target, batch))
