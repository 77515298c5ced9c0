"""Annual statistics that take new readings: exact sums per site, instrument and year, which add up in any order.

The moments of a group are its number of valid readings, their sum and the sum of their squares, all as decimals.  Decimal
sums have no rounding, so moments merged from any split of the readings, in any order, are the same to the last bit, and so
are the statistics made from them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import Rules
from .annual import described

# Readings count to this many decimals; the decimal types leave room for readings below 10^9 and, over all squares of a
# group, for 10^25.  What does not fit raises an error under ANSI rules.
DECIMALS = 6
READING = f"DECIMAL(15, {DECIMALS})"
TOTAL = f"DECIMAL(25, {DECIMALS})"
SQUARES = f"DECIMAL(38, {2 * DECIMALS})"


def moment_keys(df: DataFrame, rules: Rules) -> list[str]:
    return [*rules.keys(df), "site", "year", "measurement"]


def moments(readings: DataFrame, rules: Rules) -> DataFrame:
    """``n_ok, total, squares`` per site, instrument and year.

    One hash aggregate with a partial step in each task, like ``annual_site_stats``.  A group without a valid reading is a
    row of zeros, so that its year is known to have been reported.
    """
    exact = F.col("value").cast(READING)
    return (
        readings.withColumn("_exact", exact)
        .groupBy(*moment_keys(readings, rules))
        .agg(
            F.count("_exact").alias("n_ok"),
            F.expr(f"CAST(coalesce(sum(_exact), 0) AS {TOTAL}) AS total"),
            F.expr(f"CAST(coalesce(sum(_exact * _exact), 0) AS {SQUARES}) AS squares"),
        )
    )


def merge_moments(states: DataFrame, *more: DataFrame, rules: Rules) -> DataFrame:
    """Moments of all the readings behind some frames of moments."""
    every = reduce(DataFrame.unionByName, more, states)
    return every.groupBy(*moment_keys(every, rules)).agg(
        F.sum("n_ok").alias("n_ok"),
        F.expr(f"CAST(sum(total) AS {TOTAL}) AS total"),
        F.expr(f"CAST(sum(squares) AS {SQUARES}) AS squares"),
    )


def stats_of_moments(state: DataFrame, rules: Rules) -> DataFrame:
    """The columns of ``annual_site_stats`` from merged moments.

    The squared deviations are first taken from a decimal close to the mean, without rounding, so that nothing is lost
    however large the mean is beside the deviation; only what is left becomes a floating-point number.
    """
    near = F.expr(f"CAST(try_divide(total, n_ok) AS {READING}) AS _near")
    rest = f"CAST(total - CAST(n_ok AS DECIMAL(12, 0)) * _near AS DECIMAL(22, {DECIMALS}))"
    # sum((x - near)^2) = squares - near (2 total - n near) = squares - near (total + rest)
    around = (
        f"CAST(squares AS DECIMAL(37, {2 * DECIMALS}))"
        f" - CAST(_near * CAST(total + _rest AS DECIMAL(22, {DECIMALS})) AS DECIMAL(37, {2 * DECIMALS}))"
    )
    off = "try_divide(double(_rest), n_ok)"
    spread = f"greatest(double({around}) - n_ok * {off} * {off}, 0D)"
    stats = (
        state.select("*", near)
        .select("*", F.expr(f"{rest} AS _rest"))
        .withColumns(
            {
                "mean": F.expr("try_divide(double(total), n_ok)"),
                "sd": F.expr(f"if(n_ok > 1, sqrt({spread} / (n_ok - 1)), NULL)"),
            }
        )
    )
    return described(stats, rules)
