"""Station register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import STATIONS


def read_stations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read the register of one network, saved as Parquet or as CSV with a header."""
    if fmt == "csv":
        return spark.read.schema(STATIONS).option("header", True).option("enforceSchema", False).csv(path)
    return spark.read.format(fmt).load(path)
