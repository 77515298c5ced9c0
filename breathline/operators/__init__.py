"""DataFrame operators: each takes frames and :class:`breathline.Rules` and returns a frame."""

from .annual import annual_site_stats
from .change import (
    confidence_half_widths,
    cumulative_change,
    increment_deltas,
    reduction_summary,
    summary_absolute,
    summary_with_bounds,
)
from .cohorts import cohort_members, prefer_hourly, with_counting_flags
from .decomposition import (
    core_reduction,
    decomposed_reduction,
    edge_rows,
    relative_error,
    simplified_of_site_years,
    simplified_reduction,
    simplified_years,
    site_count_comparison,
    turnover_change,
)
from .indicators import (
    BASE_LABEL,
    annual_indicator,
    base_indicator,
    base_of_site_years,
    base_summary,
    increment_indicators,
    indicator_order,
    indicator_profile,
    indicator_table,
    population_indicator,
    split_by_indicator,
)
from .members import (
    annual_members,
    capture_statistics,
    fullest_indicator,
    included_detail,
    indicator_members,
    site_detail,
    sites_to_include,
    split_list,
)
from .moments import merge_moments, moments, stats_of_moments
from .stations import clean_stations, eligible_site_years, operational_site_years

__all__ = [
    "BASE_LABEL",
    "annual_indicator",
    "annual_members",
    "annual_site_stats",
    "base_indicator",
    "base_of_site_years",
    "base_summary",
    "capture_statistics",
    "clean_stations",
    "cohort_members",
    "confidence_half_widths",
    "core_reduction",
    "cumulative_change",
    "decomposed_reduction",
    "edge_rows",
    "eligible_site_years",
    "fullest_indicator",
    "included_detail",
    "increment_deltas",
    "increment_indicators",
    "indicator_members",
    "indicator_order",
    "indicator_profile",
    "indicator_table",
    "merge_moments",
    "moments",
    "operational_site_years",
    "population_indicator",
    "prefer_hourly",
    "reduction_summary",
    "relative_error",
    "simplified_of_site_years",
    "simplified_reduction",
    "simplified_years",
    "site_count_comparison",
    "site_detail",
    "sites_to_include",
    "split_by_indicator",
    "split_list",
    "stats_of_moments",
    "summary_absolute",
    "summary_with_bounds",
    "turnover_change",
    "with_counting_flags",
]
