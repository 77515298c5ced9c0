"""Who counts in which year: instrument preference and matched cohorts.

A cohort belongs to an increment year n.  It holds the instruments whose site-years within n-3..n are all operational
and of which at least three meet the capture threshold.  A site-year of year y can belong to the cohorts of
n = y, y+1, .., y+3, so cohort membership is four flags on the site-year, one per lead k = n - y: no row is copied, no
year is looped over and no range join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import window
from ..rules import DAILY, HOURLY, Rules

COUNTS_ALONE = "_counts_alone"


def counts(lead: int) -> str:
    """Name of the flag: the row counts in the cohort of ``year + lead``."""
    return f"_counts_{lead}"


def _in_cohort(lead: int) -> str:
    return f"_in_cohort_{lead}"


def captured(rules: Rules) -> str:
    return f"capture >= {rules.capture_threshold}"


def usable(rules: Rules) -> str:
    """Operational and well captured; unknown counts as no."""
    return f"coalesce(operational_all_year AND {captured(rules)}, false)"


def not_superseded(candidate: str, keys: list[str]) -> str:
    """``candidate`` rows, less the daily ones whose site and year also has an hourly candidate."""
    hourly_too = f"bool_or({candidate} AND measurement = '{HOURLY}') OVER {window([*keys, 'site', 'year'])}"
    return f"{candidate} AND NOT (measurement = '{DAILY}' AND {hourly_too})"


def prefer_hourly(df: DataFrame, rules: Rules, by: tuple[str, ...] = ()) -> DataFrame:
    """Drop daily rows of a site and year that has hourly rows as well."""
    kept = not_superseded("true", [*rules.keys(df), *by])
    return df.withColumn("_kept", F.expr(kept)).where("_kept").drop("_kept")


def with_cohort_flags(site_years: DataFrame, rules: Rules) -> DataFrame:
    """Add one flag per lead: whether the row is in the cohort of increment year ``year + lead``.

    Whether that year is an increment year at all (some site reports in it) is settled later, on yearly totals.
    """
    instrument = [*rules.keys(site_years), "site", "measurement"]
    flags = {}
    for lead in rules.leads:
        frame = f"RANGE BETWEEN {rules.cohort_years - 1 - lead} PRECEDING AND {lead} FOLLOWING"
        over = window(instrument, "year", frame)
        flags[_in_cohort(lead)] = F.expr(
            f"year + {lead} > {rules.base_year}"
            f" AND bool_and(coalesce(operational_all_year, false)) OVER {over}"
            f" AND count_if({captured(rules)}) OVER {over} >= {rules.cohort_min_captured}"
        )
    return site_years.withColumns(flags)


def with_counting_flags(site_years: DataFrame, rules: Rules) -> DataFrame:
    """Add, per lead, whether the row counts in the annual mean of the cohort of ``year + lead`` (operational, captured
    and not superseded by an hourly instrument in that cohort), and whether it counts without any cohort.

    Site-years that have these flags already, such as saved ones, stay as they are."""
    if COUNTS_ALONE in site_years.columns:
        return site_years
    keys = rules.keys(site_years)
    candidates = {COUNTS_ALONE: usable(rules)}
    for lead in rules.leads:
        candidates[counts(lead)] = f"({usable(rules)} AND {_in_cohort(lead)})"
    return with_cohort_flags(site_years, rules).withColumns(
        {name: F.expr(not_superseded(candidate, keys)) for name, candidate in candidates.items()}
    )


def cohort_members(site_years: DataFrame, rules: Rules, increment_year: int | None = None) -> DataFrame:
    """Site-years of every cohort, one copy per ``increment_year`` they belong to (or of one increment year only)."""
    keys = rules.keys(site_years)
    others = [c for c in site_years.columns if c not in keys]
    if increment_year is not None:
        span = F.col("year").between(increment_year - rules.cohort_years + 1, increment_year)
        site_years = site_years.where(span)
    years = ", ".join(f"if({_in_cohort(lead)}, year + {lead}, NULL)" for lead in rules.leads)
    members = with_cohort_flags(site_years, rules).select(
        *keys, F.expr(f"explode(array_compact(array({years})))").alias("increment_year"), *others
    )
    if increment_year is not None:
        return members.where(F.col("increment_year") == increment_year)
    reported = site_years.select(*keys, F.col("year").alias("increment_year")).distinct()
    return members.join(reported, [*keys, "increment_year"], "left_semi")
