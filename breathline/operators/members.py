"""Which sites stand behind an indicator: one row per site.

Membership is a relation, a row per (indicator, year, site), also in published tables, whatever the size of the network:
no task gathers all sites of an indicator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import window
from ..rules import Rules
from . import cohorts
from .indicators import BASE_LABEL, INCREMENT_YEAR, PEI, RI

def indicator_members(site_years: DataFrame, indicators: DataFrame, rules: Rules) -> DataFrame:
    """The rows of ``indicators`` (see ``indicators.indicator_table``), one for each distinct ``site`` behind them.

    Joining the indicator rows last keeps only increment years that exist and brings their columns along.
    """
    keys = rules.keys(site_years)
    first, last = rules.base_window
    labels = [f"if({cohorts.COUNTS_ALONE} AND year BETWEEN {first} AND {last}, '{BASE_LABEL}', NULL)"]
    for lead in rules.leads:
        kinds = [RI] * (lead > 0) + [PEI] * (lead < rules.indicator_years)
        labels += [f"if({cohorts.counts(lead)}, concat('{kind} ', year + {lead}), NULL)" for kind in kinds]
    members = (
        cohorts.with_counting_flags(site_years, rules)
        .select(*keys, F.expr(f"explode(array_compact(array({', '.join(labels)}))) AS indicator"), "year", "site")
        .dropDuplicates()
    )
    return members.join(indicators, [*keys, "indicator", "year"])


def annual_members(site_years: DataFrame, yearly: DataFrame, rules: Rules) -> DataFrame:
    """The rows of ``yearly`` (see ``indicators.population_indicator``), one for each distinct ``site`` behind them."""
    keys = rules.keys(site_years)
    members = (
        site_years.withColumn("_counted", F.expr(cohorts.not_superseded(cohorts.usable(rules), keys)))
        .where("_counted")
        .select(*keys, "year", "site")
        .dropDuplicates()
    )
    return members.join(yearly, [*keys, "year"])


def split_list(lists: DataFrame, column: str, into: str) -> DataFrame:
    """One row per item of a text list with items separated by semicolons, such as older tables hold."""
    return lists.withColumn(into, F.explode(F.split(column, r";\s*"))).drop(column)


def fullest_indicator(indicators: DataFrame, rules: Rules) -> DataFrame:
    """Per year, the one indicator with most sites.

    Ties go to the base window, then to the earlier increment year, then to RI.
    """
    order = f"n_sites DESC, indicator = '{BASE_LABEL}' DESC, {INCREMENT_YEAR}, startswith(indicator, '{RI}') DESC"
    rank = f"row_number() OVER {window([*rules.keys(indicators), 'year'], order)}"
    return indicators.withColumn("_rank", F.expr(rank)).where("_rank = 1").drop("_rank")


def sites_to_include(site_years: DataFrame, indicators: DataFrame, rules: Rules) -> DataFrame:
    """(year, n_sites, site): the sites behind the fullest indicator of each year."""
    keys = rules.keys(site_years)
    members = indicator_members(site_years, fullest_indicator(indicators, rules), rules)
    return members.select(*keys, "year", "n_sites", "site")


def site_detail(included: DataFrame, site_years: DataFrame, stations: DataFrame, rules: Rules) -> DataFrame:
    """Annual statistics and position of every included site and year.

    All eligible site-years of the site take part, also poorly captured ones, before daily ones give way to hourly ones.
    """
    keys = rules.keys(site_years)
    shared = [k for k in keys if k in stations.columns]
    positions = stations.select(*shared, "site", "measurement", "code", "latitude", "longitude")
    joined = (
        included.select(*keys, "year", "site")
        .join(site_years, [*keys, "site", "year"], "left")
        .join(positions, [*shared, "site", "measurement"], "left")
    )
    return cohorts.prefer_hourly(joined, rules).select(
        *[k for k in keys if k not in ("site_type", "zone")],
        "site",
        "code",
        "latitude",
        "longitude",
        "year",
        "mean",
        F.col("se_sampling_within_site").alias("se"),
        "capture",
        "measurement",
        "site_type",
        "zone",
    )


def included_detail(site_years: DataFrame, indicators: DataFrame, stations: DataFrame, rules: Rules) -> DataFrame:
    """:func:`site_detail` of :func:`sites_to_include`, without going by way of a list of sites.

    The fullest indicator of its year, of which there is one, comes to every site-year, whose own flags then tell whether it
    stands behind it.  One window by site and year finds the site-years beside it and those that give way, so site-years
    are neither copied nor joined with themselves, and stay where they lie if they are laid out by site.
    """
    keys = rules.keys(site_years)
    shared = [k for k in keys if k in stations.columns]
    chosen = fullest_indicator(indicators, rules).select(*keys, "year", F.col("indicator").alias("_indicator"))
    # one row per calendar year, unless there are many series
    chosen = chosen if keys else F.broadcast(chosen)
    lead = INCREMENT_YEAR.replace("indicator", "_indicator")
    ahead = " ".join(f"WHEN {k} THEN {cohorts.counts(k)}" for k in rules.leads)
    behind = f"if(_indicator = '{BASE_LABEL}', {cohorts.COUNTS_ALONE}, CASE int(nullif({lead}, '')) - year {ahead} END)"
    beside = window([*keys, "site", "year"])
    kept = (
        cohorts.with_counting_flags(site_years, rules)
        .join(chosen, [*keys, "year"])
        .withColumn("_behind", F.expr(f"coalesce({behind}, false)"))
        .withColumns({"_included": F.expr(f"bool_or(_behind) OVER {beside}")})
        .where("_included")
    )
    positions = stations.select(*shared, "site", "measurement", "code", "latitude", "longitude")
    return cohorts.prefer_hourly(kept, rules).join(positions, [*shared, "site", "measurement"], "left").select(
        *[k for k in keys if k not in ("site_type", "zone")],
        "site",
        "code",
        "latitude",
        "longitude",
        "year",
        "mean",
        F.col("se_sampling_within_site").alias("se"),
        "capture",
        "measurement",
        "site_type",
        "zone",
    )


def capture_statistics(site_years: DataFrame, rules: Rules) -> DataFrame:
    """Per year, how many operational site-years there are and how many of them meet the capture threshold."""
    return (
        site_years.where(F.col("operational_all_year") & (F.col("year") >= rules.statistics_from))
        .groupBy(*rules.keys(site_years), "year")
        .agg(
            F.count("*").alias("total_sites"),
            F.expr(f"count_if({cohorts.captured(rules)}) AS sites_meeting_threshold"),
        )
        .withColumn("percent_meeting_threshold", F.expr("bround(100 * sites_meeting_threshold / total_sites, 1)"))
    )
