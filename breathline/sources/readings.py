"""Readings: one filtered, pruned scan for all instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import text
from ..rules import DAILY, HOURLY, Rules
from ..schemas import READINGS
from .conform import conform_readings


def read_readings(spark: SparkSession, path: str, rules: Rules) -> DataFrame:
    """Scan a folder of Parquet readings (see ``schemas.READINGS``), keeping what ``rules`` admit.

    Readings under the older column names are brought into the standard layout first (see :func:`conform_readings`).

    The filters reach the Parquet reader; a folder laid out by ``pollutant`` or ``year`` is pruned to the partitions
    that matter.
    """
    df = spark.read.parquet(path)
    if not set(READINGS.names) <= {*df.columns}:
        df = conform_readings(df)
    return select_readings(df, rules)


def select_readings(df: DataFrame, rules: Rules) -> DataFrame:
    """Admit hourly readings of the wanted averaging and all daily readings, in the same pass.

    A NaN value is a missing reading, so it becomes NULL here, before anything counts or averages it.
    """
    admitted = [
        f"((measurement = '{HOURLY}' AND averaging = {text(rules.hourly_averaging)}) OR measurement = '{DAILY}')"
    ]
    if rules.pollutant is not None:
        admitted.append(f"pollutant = {text(rules.pollutant)}")
    if rules.first_year is not None:
        admitted.append(f"year >= {rules.first_year}")
    return df.where(" AND ".join(admitted)).select(
        *rules.keys(df),
        "site",
        "year",
        "measurement",
        *[c for c in ("date",) if c in df.columns],
        F.expr("nullif(value, double('NaN')) AS value"),
    )


def write_readings(df: DataFrame, path: str, rows_per_file: int = 20_000_000) -> None:
    """Write readings in the layout that :func:`read_readings` and the annual statistics want.

    Folders by ``pollutant`` and ``year``, so that filters on them open no other file; rows sorted by site and instrument
    in a file, so that a filter on sites skips row groups and a task condenses long runs of one site.  The shuffle is by
    ranges of (pollutant, year, site, measurement, date), which cuts a site with very many readings in two where a hash
    would not; ``rows_per_file`` bounds what one file holds.
    """
    order = ["pollutant", "year", "site", "measurement", *[c for c in ("date",) if c in df.columns]]
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("pollutant", "year")
    writer.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)
