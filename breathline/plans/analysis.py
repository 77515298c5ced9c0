"""The follow-up job: where the reduction comes from, and how a plain calculation compares."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..rules import Rules
from ..sources import saved


# What the rows of each table are sorted by, after the series keys; base rows come first.
ORDER: dict[str, tuple[str, ...]] = {
    "edges": (f"indicator <> '{op.BASE_LABEL}'", "year", "indicator"),
    "turnover": ("year",),
    "site_counts": ("year",),
}


@dataclass
class Analysis:
    edges: DataFrame
    turnover: DataFrame
    core: DataFrame
    decomposed: DataFrame
    simplified: DataFrame
    relative_error: DataFrame
    site_counts: DataFrame

    def sorted_tables(self, rules: Rules) -> dict[str, tuple[DataFrame, tuple]]:
        """Every table by name, with its order."""
        tables = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: (df, tuple(map(F.expr, (*rules.keys(df), *ORDER.get(name, ()))))) for name, df in tables.items()}


def analyse(profile: DataFrame, indicators: DataFrame, summary: DataFrame, rules: Rules) -> Analysis:
    edges = op.edge_rows(indicators, rules)
    simplified = op.simplified_reduction(profile, rules)
    return Analysis(
        edges=edges,
        turnover=op.turnover_change(edges, rules),
        core=op.core_reduction(edges, rules),
        decomposed=op.decomposed_reduction(edges, rules),
        simplified=simplified,
        relative_error=op.relative_error(summary, simplified, rules),
        site_counts=op.site_count_comparison(profile, edges, rules),
    )


def analyse_saved(spark: SparkSession, data_folder: str, rules: Rules) -> Analysis:
    """Analyse what ``Assessment.publish`` wrote."""
    profile, indicators, summary = (
        saved.load_frame(spark, f"{data_folder.rstrip('/')}/{name}")
        for name in ("profile", "indicators", "summary_absolute")
    )
    return analyse(profile, indicators, summary, rules)
