"""Readings to annual statistics per site: the one step that sees all the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import quadrature
from ..functions.sql import text
from ..rules import Rules


def expected_readings(rules: Rules) -> str:
    """Readings an instrument gives in a full year; every fourth year counts as a leap year, centuries too."""
    per_day = " ".join(f"WHEN {text(name)} THEN {float(n)}D" for name, n in rules.readings_per_day.items())
    return f"(if(year % 4 = 0, 366, 365) * CASE measurement {per_day} END)"


def annual_site_stats(readings: DataFrame, rules: Rules) -> DataFrame:
    """Mean, standard error of the mean and data capture (percent) per site, instrument and year.

    One hash aggregate for all instruments.  Its state is a few numbers per group, so each task condenses its
    readings before the shuffle and a site that holds a large part of all readings does no harm.
    A year without any valid reading has NULL mean and zero capture.
    """
    keys = rules.keys(readings)
    stats = readings.groupBy(*keys, "site", "year", "measurement").agg(
        F.avg("value").alias("mean"),
        F.count("value").alias("n_ok"),
        F.stddev_samp("value").alias("sd"),
    )
    return described(stats, rules)


def described(stats: DataFrame, rules: Rules) -> DataFrame:
    """Annual statistics from ``mean``, ``n_ok`` and ``sd``."""
    error = "try_divide(sd, sqrt(n_ok))"
    if rules.measurement_error:
        error = quadrature(error, f"mean * {rules.measurement_error!r}D")
    return stats.select(
        *rules.keys(stats),
        "site",
        "year",
        "mean",
        F.expr(error).alias("se_sampling_within_site"),
        F.expr(f"n_ok / {expected_readings(rules)} * 100").alias("capture"),
        "measurement",
    )
