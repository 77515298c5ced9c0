"""View a sales star schema as a monitoring network.

Suppliers play the sites and shipped lines play the readings: the ship date is the time, the quantity the
concentration.  A supplier has an hourly instrument, a daily one, or both, by its key, so every line gives one or two
readings; a zero discount (hourly) or zero tax (daily) marks a missing one.  Lines of a supplier that is not listed are
no readings of any site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import DAILY, HOURLY, HOURLY_AVERAGING, POLLUTANT, Rules

# The columns in use; declaring them spares a job that looks them up in the files.
TABLES = {
    "lineitem": "l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_shipdate TIMESTAMP_NTZ",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "nation": "n_nationkey INT, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}

# The period of the sales data, and instruments that report every fourth day.
SALES_RULES = Rules(
    first_year=None,
    readings_per_day={HOURLY: 0.25, DAILY: 0.25},
    excluded_zones="AFRICA",
    site_exceptions={},
    renamed_sites={},
    base_window=(1995, 1997),
    base_year=1997,
    statistics_from=1995,
)

OTHER_POLLUTANT = "NO2"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _instruments(key: str) -> str:
    both, daily, hourly = f"array('{HOURLY}', '{DAILY}')", f"array('{DAILY}')", f"array('{HOURLY}')"
    return f"explode(CASE {key} % 4 WHEN 0 THEN {both} WHEN 3 THEN {daily} ELSE {hourly} END) AS measurement"


def sales_readings(
    spark: SparkSession,
    folder: str,
    named: bool = True,
    mixed_pollutants: bool = False,
    years: tuple[int | None, int | None] = (None, None),
) -> DataFrame:
    """Readings as in ``schemas.READINGS``.

    Without ``named``, ``site`` is the supplier's key, to be named by :func:`name_sites` once the readings are condensed,
    which are far fewer rows to join with the suppliers.  ``mixed_pollutants`` gives the seventh line of an order another
    pollutant.  ``years`` are the first and last year of interest; as bounds on the ship date they reach the file reader.
    """
    first, last = years
    period = [f"l_shipdate >= TIMESTAMP_NTZ '{first}-01-01'"] * (first is not None)
    period += [f"l_shipdate < TIMESTAMP_NTZ '{(last or 0) + 1}-01-01'"] * (last is not None)
    pollutant = f"'{POLLUTANT}'"
    if mixed_pollutants:
        pollutant = f"if(l_linenumber = 7, '{OTHER_POLLUTANT}', {pollutant})"
    hourly, daily = "if(l_discount = 0, NULL, l_quantity)", "if(l_tax = 0, NULL, l_quantity * 1.1D)"
    readings = (
        _table(spark, folder, "lineitem")
        .where(" AND ".join(["l_suppkey IS NOT NULL", *period]))
        .select("*", F.expr(_instruments("l_suppkey")))
        .selectExpr(
            "l_suppkey AS site",
            "year(l_shipdate) AS year",
            "l_shipdate AS date",
            f"if(measurement = '{HOURLY}', {hourly}, {daily}) AS value",
            "measurement",
            f"'{HOURLY_AVERAGING}' AS averaging",
            f"{pollutant} AS pollutant",
        )
    )
    return name_sites(readings, spark, folder) if named else readings


def name_sites(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Turn supplier keys in ``site`` into the suppliers' names; rows of unlisted suppliers go."""
    suppliers = _table(spark, folder, "supplier").select("s_suppkey", "s_name")
    named = df.join(suppliers, F.col("site") == F.col("s_suppkey"))
    return named.select(*[F.col("s_name").alias("site") if c == "site" else F.col(c) for c in df.columns])


def sales_stations(spark: SparkSession, folder: str) -> DataFrame:
    """Station register as in ``schemas.STATIONS``: one row per supplier and instrument."""
    supplier, nation, region = (_table(spark, folder, name) for name in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("*", F.expr(_instruments("s_suppkey")))
        .selectExpr(
            "s_name AS site",
            "concat('S', s_suppkey) AS code",
            "50 + s_suppkey % 100 / 20 AS latitude",
            "s_suppkey % 60 / 10 - 4 AS longitude",
            "CASE s_suppkey % 10 WHEN 9 THEN 'Urban Traffic' WHEN 8 THEN 'Suburban Background'"
            " ELSE 'Urban Background' END AS site_type",
            "r_name AS zone",
            f"if(measurement = '{HOURLY}', 'PM2.5', 'GR2.5') AS variable",
            "if(s_suppkey % 7 = 5, '1996-03-01', '1990-01-01') AS start_date",
            "if(s_suppkey % 11 = 10, '2000-06-30', 'ongoing') AS end_date",
        )
    )
