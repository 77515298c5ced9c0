"""The numbers and names that define the indicator, in one immutable object.

Every operator takes a :class:`Rules`.  ``Rules()`` is the published definition; another network, pollutant or
period is a ``dataclasses.replace`` away.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping

from pyspark.sql import DataFrame

# Fixed values ---------------------------------------------------------------------------------------------------
# They must be exactly these for results to match the published definition.
POLLUTANT = "PM2.5"
HOURLY, DAILY = "Hourly", "Daily"
HOURLY_AVERAGING = "None"
FIRST_YEAR = 2009
CAPTURE_THRESHOLD = 85
BASE_WINDOW = (2016, 2018)
BASE_YEAR = 2018
INDICATOR_YEARS = 3
COHORT_YEARS = 4
COHORT_MIN_CAPTURED = 3
Z_95 = 1.96
READINGS_PER_DAY = {"Hourly": 24, "Daily": 1}
STATION_VARIABLES = {"PM2.5": "Hourly", "GR2.5": "Daily"}
EXCLUDED_ZONES = "Scottish|Scotland|Highland|Wales|Ireland"
SITE_TYPES = ("Suburban Background", "Urban Background")
SITE_EXCEPTIONS = {"Warrington": 2022, "Middlesbrough": 2022}
RENAMED_SITES = {"Dewsbury Ashworth Grove": "Dewsbury Ashworth Grange"}
OPEN_ENDED = "ongoing"
STATISTICS_FROM = 2016
# ----------------------------------------------------------------------------------------------------------------


def _frozen(mapping: Mapping) -> Mapping:
    return field(default_factory=lambda: MappingProxyType(dict(mapping)))


@dataclass(frozen=True)
class Rules:
    """Parameters of an assessment.

    ``series`` names extra key columns (for example ``("network", "pollutant")`` or ``("zone",)``).  They join every
    group, join and window key, so one job computes any number of independent indicator series side by side.  Empty
    means one series.
    """

    series: tuple[str, ...] = ()
    # which readings count (``pollutant=None`` keeps all of them, for use with a pollutant series key)
    pollutant: str | None = POLLUTANT
    hourly_averaging: str = HOURLY_AVERAGING
    first_year: int | None = FIRST_YEAR
    readings_per_day: Mapping[str, float] = _frozen(READINGS_PER_DAY)
    # relative error of one annual mean, combined in quadrature with the sampling error
    measurement_error: float = 0.0
    # which stations count
    station_variables: Mapping[str, str] = _frozen(STATION_VARIABLES)
    renamed_sites: Mapping[str, str] = _frozen(RENAMED_SITES)
    excluded_zones: str = EXCLUDED_ZONES
    site_types: tuple[str, ...] = SITE_TYPES
    # site -> first year it is admitted
    site_exceptions: Mapping[str, int] = _frozen(SITE_EXCEPTIONS)
    capture_threshold: float = CAPTURE_THRESHOLD
    # how indicators are built
    base_window: tuple[int, int] = BASE_WINDOW
    base_year: int = BASE_YEAR
    indicator_years: int = INDICATOR_YEARS
    cohort_years: int = COHORT_YEARS
    cohort_min_captured: int = COHORT_MIN_CAPTURED
    z: float = Z_95
    statistics_from: int = STATISTICS_FROM
    # add the mean sampling error within sites, in quadrature, to the error of a mean over sites
    within_site_error: bool = False

    def __post_init__(self) -> None:
        if self.cohort_years != self.indicator_years + 1:
            raise ValueError("a cohort spans the years of two successive indicators: indicator_years + 1")

    def keys(self, df: DataFrame) -> list[str]:
        """Series columns that ``df`` has (readings may lack those that come with the stations)."""
        return [k for k in self.series if k in df.columns]

    @property
    def leads(self) -> range:
        """Distances k >= 0 from a year to the increment years ``year + k`` whose cohort window covers it."""
        return range(self.cohort_years)
