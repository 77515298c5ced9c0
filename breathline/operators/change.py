"""From indicators to increments, cumulative change and percent reduction, with errors and intervals.

These frames hold one row per series and year.  Errors of RI, PEI and successive increments are combined as if
independent, although they share years and sites; that is part of the published definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up, quadrature, running_sum
from ..functions.sql import window
from ..rules import Rules
from .indicators import ALONE, PEI, RI, in_base, three_year_mean

MEASURES = ("PEI", "delta_PEI", "delta_PEI_cumulative", "perc_change")
CHANGES = ("delta_PEI", "se_delta_PEI", "delta_PEI_cumulative", "se_delta_PEI_cumulative")


def _columns(texts: dict[str, str]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in texts.items()]


def _side_by_side(rules: Rules, kind: str) -> dict[str, str]:
    """Three-year means and errors of RI and PEI as columns; NULL where a year has no such indicator."""
    texts = {}
    for name in (RI, PEI):
        only = f"{kind} = '{name}'"
        mean, error = three_year_mean(rules, only)
        texts[f"mean_{name}"] = mean
        texts[f"se_{name}"] = f"CASE WHEN count_if({only}) > 0 THEN {error} END"
    return texts


# A fall in concentration is a positive increment.
DELTA = {
    "delta_PEI": half_up("(mean_RI - mean_PEI)", 2),
    "se_delta_PEI": quadrature("se_PEI", "se_RI"),
}


def _running_totals(keys: list[str], year: str) -> dict[str, str]:
    """A missing increment leaves the total unknown from there on."""
    so_far = window(keys, year, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    return {
        "delta_PEI_cumulative": running_sum("delta_PEI", so_far),
        "se_delta_PEI_cumulative": f"sqrt({running_sum('se_delta_PEI * se_delta_PEI', so_far)})",
    }


def increment_deltas(increments: DataFrame, rules: Rules) -> DataFrame:
    """Per increment year, RI and PEI, the increment RI - PEI in two digits, and their errors.

    ``increments`` is the result of ``indicators.increment_indicators``.
    """
    means = increments.groupBy(*rules.keys(increments), "increment_year").agg(
        *_columns(_side_by_side(rules, "indicator"))
    )
    return means.select("*", *_columns(DELTA))


def cumulative_change(deltas: DataFrame, rules: Rules) -> DataFrame:
    """Running total of the increments and of their errors, in year order."""
    return deltas.select("*", *_columns(_running_totals(rules.keys(deltas), "increment_year")))


def reduction_summary(profile: DataFrame, rules: Rules) -> DataFrame:
    """Per year: indicator, increment, cumulative change and percent change against the base, with standard errors.

    The first row is the base year, without changes; a series without data in the base window has it too, with no value and
    error 0.  The base value travels to the later rows of its series by a window, not by a join.
    """
    keys = rules.keys(profile)
    is_base, at_base = f"kind = '{ALONE}'", f"year = {rules.base_year}"
    base_mean, base_error = three_year_mean(rules, is_base)
    means = (
        profile.select(
            *keys,
            "kind",
            F.expr(f"coalesce(increment_year, {rules.base_year}) AS year"),
            *[F.expr(f"if(kind <> '{ALONE}' OR {in_base(rules)}, {c}, NULL) AS {c}") for c in ("mean", "se_total")],
        )
        .groupBy(*keys, "year")
        .agg(*_columns({"_base": half_up(base_mean, 2), "_se_base": base_error, **_side_by_side(rules, "kind")}))
    )
    # the base row is no increment: it starts the running totals at nothing and shows NULL itself
    changes = means.select(
        *keys,
        "year",
        *_columns({name: f"if({at_base}, 0D, {text})" for name, text in DELTA.items()}),
        *_columns(
            {
                "base_PEI": f"max(if({at_base}, _base, NULL)) OVER {window(keys)}",
                "base_se_PEI": f"max(if({at_base}, _se_base, NULL)) OVER {window(keys)}",
            }
        ),
    )
    totals = changes.select("*", *_columns(_running_totals(keys, "year")))
    change, change_error = "delta_PEI_cumulative", "se_delta_PEI_cumulative"
    percent = f"try_divide(100 * {change}, base_PEI)"
    # error of a ratio of two uncertain values, to first order
    percent_error = quadrature(
        f"try_divide(100, base_PEI) * {change_error}", f"try_divide(100 * {change}, base_PEI * base_PEI) * base_se_PEI"
    )
    return totals.select(
        *keys,
        "year",
        *_columns(
            {
                "PEI": f"if({at_base}, base_PEI, base_PEI - {change})",
                "se_PEI": f"if({at_base}, base_se_PEI, {quadrature('base_se_PEI', change_error)})",
                **{name: f"if({at_base}, NULL, {name})" for name in CHANGES},
                "perc_change": f"if({at_base}, NULL, {half_up(percent, 2)})",
                "se_perc_change": f"if({at_base}, NULL, {percent_error})",
            }
        ),
    )


def confidence_half_widths(summary: DataFrame, rules: Rules) -> DataFrame:
    """Add ``ci_*``: the half-width of the normal confidence interval of each measure, in two digits."""
    return summary.select("*", *_columns({f"ci_{m}": half_up(f"({rules.z!r}D * se_{m})", 2) for m in MEASURES}))


def summary_with_bounds(intervals: DataFrame, rules: Rules) -> DataFrame:
    """Each measure with lower and upper bound.

    Percent bounds come from the two-digit percent and are then rounded to whole numbers, as is the percent itself.
    """
    texts = {}
    for m in MEASURES:
        trio = {m: m, f"ci_{m}_lower": f"({m} - ci_{m})", f"ci_{m}_upper": f"({m} + ci_{m})"}
        texts |= {name: half_up(text) if m == "perc_change" else text for name, text in trio.items()}
    return intervals.select(*rules.keys(intervals), "year", *_columns(texts))


def summary_absolute(intervals: DataFrame, rules: Rules) -> DataFrame:
    """Each measure with its half-width; the percent keeps two digits."""
    return intervals.select(*rules.keys(intervals), "year", *[c for m in MEASURES for c in (m, f"ci_{m}")])
