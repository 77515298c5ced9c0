"""Frames kept between jobs, as Parquet or as a bucketed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_frame(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_site_years(spark: SparkSession, path: str, series: tuple[str, ...] = ()) -> DataFrame:
    """Saved site-years, laid out by series and site.

    The cohort and instrument rules look at (site, measurement) and at (site, year); this one shuffle serves both.
    """
    return spark.read.parquet(path).repartition(*series, "site")


def save_bucketed(df: DataFrame, table: str, buckets: int) -> None:
    """Keep readings or site-years as a catalog table bucketed and sorted by site.

    Readings are then aggregated without a shuffle, and site-years pass the cohort and instrument rules without one.
    """
    df.repartition(buckets, "site").write.mode("overwrite").bucketBy(buckets, "site").sortBy("site").saveAsTable(table)
