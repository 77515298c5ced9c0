"""Declared column layouts (names, types, order)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

READINGS = T.StructType(
    [
        T.StructField("site", T.StringType(), False),
        T.StructField("year", T.IntegerType(), False),
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("measurement", T.StringType(), False),
        T.StructField("averaging", T.StringType()),
        T.StructField("pollutant", T.StringType(), False),
    ]
)

# The standard layout of a readings table and the older column names that it replaces.
STANDARD_READINGS = T.StructType(
    [
        T.StructField("network", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("site", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("site_type", T.StringType()),
        T.StructField("local_authority", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("agglomeration", T.StringType()),
        T.StructField("pollutant", T.StringType()),
        T.StructField("measurement", T.StringType()),
        T.StructField("averaging", T.StringType()),
        T.StructField("data_capture", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("ratified", T.StringType()),
    ]
)
STANDARD_NAME_FOR = {"qc": "ratified", "poll_index": "value"}

# The columns of a station register.
STATIONS = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("site_type", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("start_date", T.StringType()),
        T.StructField("end_date", T.StringType()),
    ]
)

SITE_YEARS = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("se_sampling_within_site", T.DoubleType()),
        T.StructField("capture", T.DoubleType()),
        T.StructField("measurement", T.StringType()),
        T.StructField("site_type", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("start_date", T.IntegerType()),
        T.StructField("end_date", T.IntegerType()),
        T.StructField("operational_all_year", T.BooleanType()),
    ]
)

# What an indicator needs to know about a site-year.
INDICATOR_INPUT = (
    "year",
    "site",
    "measurement",
    "mean",
    "se_sampling_within_site",
    "capture",
    "operational_all_year",
)


class MissingColumnsError(ValueError):
    """An input frame lacks columns that the operator needs."""


def require_columns(df: DataFrame, needed) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"input frame has no column {', '.join(missing)}")
