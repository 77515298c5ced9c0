"""Split the overall reduction into a core part and the effect of changing sites, and compare it with a plain one.

These operators start from a (saved) indicator table, ``indicators.indicator_table``, which holds a few rows per year.
A fall is negative here, while ``perc_change`` of the summary is positive for a fall.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up, sum_or_null
from ..functions.sql import window
from ..rules import Rules
from .indicators import ALONE, BASE_LABEL, INCREMENT_YEAR, PEI, RI, three_year_mean, yearly_means

IS_BASE = f"indicator = '{BASE_LABEL}'"
IS_RI = f"startswith(indicator, '{RI}')"
# also true for the base label
IS_PEI = f"startswith(indicator, '{PEI}')"
# unknown (at either end of the order) is not a duplicate
IN_CORE = "(NOT shares_year OR shares_year IS NULL)"

# Totals of the annual means of the base window, of the first years after it, and of the last years (of any increment).
COMPONENTS = {
    "total_of_base": IS_BASE,
    "total_after_base": "indicator RLIKE '^RI'",
    "total_at_end": "indicator RLIKE '^PEI [0-9]'",
}


def edge_rows(indicators: DataFrame, rules: Rules) -> DataFrame:
    """Base rows, the first year of every RI and the last year of every PEI; the years between cancel out.

    ``edge_before`` and ``edge_after`` are the neighbours when base rows come first and all others follow by year;
    ``shares_year`` tells whether one of them is the same year (NULL if unknown at either end).
    """
    keys = rules.keys(indicators)
    years = [*keys, "indicator"]
    first = f"row_number() OVER {window(years, 'year')} = 1"
    last = f"row_number() OVER {window(years, 'year DESC')} = 1"
    # rows of the same year keep the order of the indicator table: by increment year, RI before PEI
    in_order = window(keys, f"{IS_BASE} DESC, year, {INCREMENT_YEAR}, {IS_RI} DESC")
    return (
        indicators.select(
            *keys, "indicator", "year", "mean", "n_sites", F.expr(f"{first} AS _first"), F.expr(f"{last} AS _last")
        )
        .where(f"{IS_BASE} OR ({IS_RI} AND _first) OR ({IS_PEI} AND _last)")
        .drop("_first", "_last")
        .select(
            "*",
            F.expr(f"lag(year) OVER {in_order} AS edge_before"),
            F.expr(f"lead(year) OVER {in_order} AS edge_after"),
        )
        .withColumn("shares_year", F.expr("year = edge_before OR year = edge_after"))
    )


def turnover_change(edges: DataFrame, rules: Rules) -> DataFrame:
    """Years with both an RI and a PEI edge: how the annual mean changed because the cohort did."""
    return (
        edges.where("shares_year")
        .withColumn("type", F.expr(f"if(indicator RLIKE '^PEI', '{PEI}', '{RI}')"))
        .groupBy(*rules.keys(edges), "year")
        .pivot("type", [PEI, RI])
        .agg(F.max("mean"))
        .withColumn("turnover", F.col(RI) - F.col(PEI))
    )


def _component_totals(rows: str) -> list:
    return [F.expr(f"sum(if({rows} AND {which}, mean, NULL))").alias(name) for name, which in COMPONENTS.items()]


def core_reduction(edges: DataFrame, rules: Rules) -> DataFrame:
    """The three totals of all other edge rows, in one row per series."""
    return edges.groupBy(*rules.keys(edges)).agg(*_component_totals(IN_CORE))


def decomposed_reduction(edges: DataFrame, rules: Rules) -> DataFrame:
    """Percent reduction as core part less turnover part (negative for a fall).

    Both parts come from the same edge rows, so they are summed together, first by year and then over the years.
    """
    keys = rules.keys(edges)
    turned_over = "coalesce(bool_or(shares_year), false)"
    before, after = (f"max(if(shares_year AND {side}, mean, NULL))" for side in (f"NOT {IS_PEI}", IS_PEI))
    by_year = edges.groupBy(*keys, "year").agg(
        *_component_totals(IN_CORE),
        # a turned-over year without one of its two sides makes the turnover unknown
        F.expr(f"if({turned_over}, {before} - {after}, 0D) AS _change"),
    )
    totals = by_year.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in COMPONENTS], F.expr(f"{sum_or_null('_change')} AS _change")
    )
    return totals.select(
        *keys,
        F.expr("try_divide(100 * (total_at_end - total_after_base), total_of_base) AS core_component"),
        F.expr("try_divide(100 * _change, total_of_base) AS turnover_component"),
    ).withColumn("decomposed_reduction", F.expr("core_component - turnover_component"))


def simplified_years(profile: DataFrame, rules: Rules) -> DataFrame:
    """Annual means without cohorts, of the base window and of the target window (up to the latest year with data)."""
    return _simplified_years(profile.where(f"kind = '{ALONE}'"), rules)


def _simplified_years(yearly: DataFrame, rules: Rules) -> DataFrame:
    keys = rules.keys(yearly)
    first, last = rules.base_window
    return (
        yearly.select(*keys, "year", F.expr(f"max(year) OVER {window(keys)} AS latest_year"), "mean", "se_total", "n_sites")
        .select(
            "*",
            F.expr(f"year BETWEEN {first} AND {last} AS in_base"),
            F.expr(f"year > latest_year - {rules.indicator_years} AS in_target"),
        )
        .where("(in_base OR in_target) AND n_sites > 0")
    )


def simplified_reduction(profile: DataFrame, rules: Rules) -> DataFrame:
    """Percent change between the base and the target three-year mean, each year judged on its own
    (negative for a fall)."""
    return _simplified(simplified_years(profile, rules), rules)


def simplified_of_site_years(site_years: DataFrame, rules: Rules) -> DataFrame:
    """:func:`simplified_reduction` from site-years, without the cohorts that a profile has and this has no use for."""
    return _simplified(_simplified_years(yearly_means(site_years, rules), rules), rules)


def _simplified(years: DataFrame, rules: Rules) -> DataFrame:
    keys = rules.keys(years)
    columns = [F.max("latest_year").alias("year")]
    for name in ("base", "target"):
        mean, error = three_year_mean(rules, f"in_{name}")
        columns += [F.expr(f"{half_up(mean, 2)} AS {name}_PEI"), F.expr(f"{error} AS {name}_se_PEI")]
    summary = years.groupBy(*keys).agg(*columns)
    change = "try_divide(100 * (target_PEI - base_PEI), base_PEI)"
    return summary.withColumn("simplified_reduction", F.expr(change))


def relative_error(summary: DataFrame, simplified: DataFrame, rules: Rules) -> DataFrame:
    """By how many percent the simplified reduction misses the summary's percent change in the latest year.

    The two have opposite sign for a fall (see the module text), so their sum is the difference in size.
    One row per series on each side; they are stacked and folded, which needs no join.
    """
    keys = rules.keys(summary)
    true = summary.groupBy(*keys).agg(F.max_by("perc_change", "year").alias("true_reduction"))
    sizes = true.unionByName(simplified.select(*keys, "simplified_reduction"), allowMissingColumns=True)
    return (
        sizes.groupBy(*keys)
        .agg(*[F.max(c).alias(c) for c in ("true_reduction", "simplified_reduction")])
        .withColumn(
            "relative_error", F.expr("try_divide(-100 * (true_reduction + simplified_reduction), true_reduction)")
        )
    )


def site_count_comparison(profile: DataFrame, edges: DataFrame, rules: Rules) -> DataFrame:
    """Sites behind the target years: without cohorts, and (where the year is an edge) with them."""
    keys = rules.keys(profile)
    plain = simplified_years(profile, rules).where("in_target")
    matched = edges.select(*keys, "year", F.col("n_sites").alias("true_sites"))
    return plain.select(*keys, "year", F.col("n_sites").alias("simplified_sites")).join(
        matched, [*keys, "year"], "left"
    )
