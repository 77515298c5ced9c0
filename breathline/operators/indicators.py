"""Annual means over sites, three-year indicators, and the yearly profile all later results are derived from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up, quadrature, root_sum_of_squares
from ..functions.sql import window
from ..rules import Rules
from ..schemas import INDICATOR_INPUT, require_columns
from . import cohorts

# Kinds of annual means in a profile.
ALONE, RI, PEI = "ALONE", "RI", "PEI"
# Label of the base indicator (fixed value); those of the increments are "RI 2019", "PEI 2019" and so on.
BASE_LABEL = "PEI base"
# The increment year within a label, as text.
INCREMENT_YEAR = r"regexp_extract(indicator, '[0-9]+$', 0)"


def _over_sites(counted: str, rules: Rules) -> dict[str, str]:
    """Aggregates over the ``counted`` rows: n_sites counts rows, also those without a mean, and the standard error is
    the one between sites, combined with the mean one within sites if the rules ask for it."""
    mean, rows = f"if({counted}, mean, NULL)", f"count_if({counted})"
    error = f"try_divide(stddev_samp({mean}), sqrt({rows}))"
    if rules.within_site_error:
        within = root_sum_of_squares(f"if({counted}, se_sampling_within_site, NULL)")
        error = quadrature(error, f"try_divide({within}, {rows})")
    return {"mean": f"avg({mean})", "se_total": error, "n_sites": rows}


def yearly_means(site_years: DataFrame, rules: Rules) -> DataFrame:
    """Annual means over the sites that count without any cohort; also years in which none does."""
    return _yearly(site_years, rules, rules.keys(site_years))


def _yearly(site_years: DataFrame, rules: Rules, keys: list[str]) -> DataFrame:
    """Annual means over sites; a year in which no site counts stays, with ``n_sites`` 0."""
    require_columns(site_years, INDICATOR_INPUT)
    counted = cohorts.not_superseded(cohorts.usable(rules), keys)
    aggregates = [F.expr(text).alias(name) for name, text in _over_sites("_counted", rules).items()]
    return site_years.withColumn("_counted", F.expr(counted)).groupBy(*keys, "year").agg(*aggregates)


def annual_indicator(site_years: DataFrame, rules: Rules, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over sites, its standard error and the number of sites, for every year.

    Each year counts the instruments operational and captured in that year; a site measured both ways counts with its
    hourly instrument.  ``by`` adds group columns, such as the increment year of ``cohorts.cohort_members``.
    """
    return _yearly(site_years, rules, [*rules.keys(site_years), *by]).where(F.col("n_sites") > 0)


def population_indicator(site_years: DataFrame, rules: Rules, end_year: int | None = None) -> DataFrame:
    """:func:`annual_indicator` of the three years up to ``end_year`` (default: the latest year of the series)."""
    keys = rules.keys(site_years)
    if end_year is not None:
        span = F.col("year").between(end_year - rules.indicator_years + 1, end_year)
        return annual_indicator(site_years.where(span), rules)
    return (
        _yearly(site_years, rules, keys)
        .withColumn("_latest", F.expr(f"max(year) OVER {window(keys)}"))
        .where(f"year > _latest - {rules.indicator_years} AND n_sites > 0")
        .drop("_latest")
    )


def split_by_indicator(cohort_years: DataFrame, rules: Rules) -> DataFrame:
    """Annual means per ``increment_year`` as rows of its RI (all but the last year) and PEI (all but the first)."""
    kinds = (
        f"array(if(increment_year > year, '{RI}', NULL),"
        f" if(increment_year < year + {rules.indicator_years}, '{PEI}', NULL))"
    )
    return cohort_years.withColumn("indicator", F.expr(f"explode(array_compact({kinds}))"))


def indicator_profile(site_years: DataFrame, rules: Rules) -> DataFrame:
    """All annual means of all cohorts, in one pass over the eligible site-years.

    Rows: ``kind`` ALONE (no cohort; one row per year with data, even if no site counts), RI (years n-3..n-1 of the
    cohort of ``increment_year`` n) and PEI (years n-2..n), with ``year, mean, se_total, n_sites``.

    A single aggregate by year carries the five variants of the mean side by side (no cohort, and one per lead), so
    tasks condense their site-years to a row per year before the shuffle, whatever their distribution.  The rest works
    on those few rows, brought together per series.
    """
    require_columns(site_years, INDICATOR_INPUT)
    keys = rules.keys(site_years)
    variants = {"alone": cohorts.COUNTS_ALONE, **{f"lead_{k}": cohorts.counts(k) for k in rules.leads}}
    structs = []
    for name, counted in variants.items():
        fields = ", ".join(f"{text} AS {field}" for field, text in _over_sites(counted, rules).items())
        structs.append(F.expr(f"struct({fields}) AS {name}"))
    totals = cohorts.with_counting_flags(site_years, rules).groupBy(*keys, "year").agg(*structs)

    def row(kind: str, increment_year: str, stats: str) -> str:
        return f"struct('{kind}' AS kind, {increment_year} AS increment_year, {stats} AS stats)"

    rows = [row(ALONE, "int(NULL)", "alone")]
    for lead in rules.leads:
        if lead > 0:
            rows.append(row(RI, f"year + {lead}", f"lead_{lead}"))
        if lead < rules.indicator_years:
            rows.append(row(PEI, f"year + {lead}", f"lead_{lead}"))
    # an increment year is one that some site reports in
    return (
        totals.withColumn("_reported", F.expr(f"collect_set(year) OVER {window(keys)}"))
        .select(*keys, "year", "_reported", F.expr(f"inline(array({', '.join(rows)}))"))
        .where(f"kind = '{ALONE}' OR (array_contains(_reported, increment_year) AND stats.n_sites > 0)")
        .select(*keys, "kind", "increment_year", "year", "stats.mean", "stats.se_total", "stats.n_sites")
    )


def increment_indicators(profile: DataFrame, rules: Rules) -> DataFrame:
    """The RI and PEI rows of every increment year."""
    kind = F.col("kind").alias("indicator")
    return profile.where(f"kind <> '{ALONE}'").select(
        *rules.keys(profile), "increment_year", kind, "year", "mean", "se_total", "n_sites"
    )


def in_base(rules: Rules) -> str:
    """Profile rows that make up the base indicator."""
    first, last = rules.base_window
    return f"(kind = '{ALONE}' AND year BETWEEN {first} AND {last} AND n_sites > 0)"


def base_indicator(profile: DataFrame, rules: Rules) -> DataFrame:
    """Annual means of the base window."""
    return profile.where(in_base(rules)).select(*rules.keys(profile), "year", "mean", "se_total", "n_sites")


def three_year_mean(rules: Rules, only: str = "true") -> tuple[str, str]:
    """Aggregates giving a three-year mean and its error.  The divisor stays three if years are missing."""
    return (
        f"avg(if({only}, mean, NULL))",
        f"{root_sum_of_squares(f'if({only}, se_total, NULL)')} / {rules.indicator_years}",
    )


def _base(yearly: DataFrame, rules: Rules, counted: str) -> DataFrame:
    keys = rules.keys(yearly)
    mean, error = three_year_mean(rules, counted)
    return (
        yearly.groupBy(*keys)
        .agg(F.expr(f"{half_up(mean, 2)} AS PEI"), F.expr(f"{error} AS se_PEI"))
        .select(*keys, F.lit(rules.base_year).alias("year"), "PEI", "se_PEI")
    )


def base_summary(profile: DataFrame, rules: Rules) -> DataFrame:
    """The base indicator: mean of the base window, rounded to two digits, and its standard error.

    A row for every series; one without any data in the base window has no mean, and error 0.
    """
    return _base(profile, rules, in_base(rules))


def base_of_site_years(site_years: DataFrame, rules: Rules) -> DataFrame:
    """:func:`base_summary` straight from site-years.  A single series reads the base window only; where there are several,
    the other years tell which ones there are."""
    keys = rules.keys(site_years)
    first, last = rules.base_window
    within = f"year BETWEEN {first} AND {last}"
    if not keys:
        return _base(annual_indicator(site_years.where(within), rules), rules, "true")
    return _base(_yearly(site_years, rules, keys), rules, f"({within} AND n_sites > 0)")


def indicator_order() -> tuple[Column, ...]:
    """Rows of an indicator table in order: the base window, then by increment year, RI before PEI, then by year."""
    texts = (f"indicator <> '{BASE_LABEL}'", INCREMENT_YEAR, f"NOT startswith(indicator, '{RI}')", "year")
    return tuple(F.expr(text) for text in texts)


def indicator_table(profile: DataFrame, rules: Rules) -> DataFrame:
    """One row per labelled indicator and year: the base window, then each increment's RI and PEI."""
    label = F.expr(f"if(kind = '{ALONE}', '{BASE_LABEL}', concat_ws(' ', kind, increment_year)) AS indicator")
    return profile.where(f"kind <> '{ALONE}' OR {in_base(rules)}").select(
        *rules.keys(profile), label, "year", "mean", "se_total", "n_sites"
    )


__all__ = [
    "ALONE",
    "BASE_LABEL",
    "INCREMENT_YEAR",
    "PEI",
    "RI",
    "annual_indicator",
    "base_indicator",
    "base_of_site_years",
    "base_summary",
    "increment_indicators",
    "in_base",
    "indicator_order",
    "indicator_profile",
    "indicator_table",
    "population_indicator",
    "split_by_indicator",
    "three_year_mean",
    "yearly_means",
]
