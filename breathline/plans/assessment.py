"""The main job: readings and stations in, indicator, change and site tables out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from .. import operators as op
from ..rules import Rules
from ..sources import published, saved, versions


@dataclass
class Assessment:
    """Results of one assessment, each a lazy frame.

    ``site_years`` are the eligible ones and ``profile`` the yearly totals they condense to.  All later frames hang off
    these two, so :meth:`saved_in` writes both once and no later result reads the readings again.
    """

    rules: Rules
    stations: DataFrame
    site_years: DataFrame
    profile: DataFrame

    @cached_property
    def base(self) -> DataFrame:
        return op.base_summary(self.profile, self.rules)

    @cached_property
    def increments(self) -> DataFrame:
        return op.increment_indicators(self.profile, self.rules)

    @cached_property
    def deltas(self) -> DataFrame:
        return op.cumulative_change(op.increment_deltas(self.increments, self.rules), self.rules)

    @cached_property
    def summary(self) -> DataFrame:
        return op.reduction_summary(self.profile, self.rules)

    @cached_property
    def intervals(self) -> DataFrame:
        return op.confidence_half_widths(self.summary, self.rules)

    @cached_property
    def bounds(self) -> DataFrame:
        return op.summary_with_bounds(self.intervals, self.rules)

    @cached_property
    def absolute(self) -> DataFrame:
        return op.summary_absolute(self.intervals, self.rules)

    @cached_property
    def indicators(self) -> DataFrame:
        return op.indicator_table(self.profile, self.rules)

    @cached_property
    def members(self) -> DataFrame:
        members = op.indicator_members(self.site_years, self.indicators, self.rules)
        return members.select(*self.rules.keys(members), "indicator", "year", "site")

    @cached_property
    def included(self) -> DataFrame:
        return op.sites_to_include(self.site_years, self.indicators, self.rules)

    @cached_property
    def site_detail(self) -> DataFrame:
        return op.included_detail(self.site_years, self.indicators, self.stations, self.rules)

    @cached_property
    def capture_statistics(self) -> DataFrame:
        return op.capture_statistics(self.site_years, self.rules)

    def published_bounds(self) -> DataFrame:
        return self._published(self.bounds, published.BOUNDS_HEADERS)

    def published_absolute(self) -> DataFrame:
        return self._published(self.absolute, published.ABSOLUTE_HEADERS)

    def published_indicators(self) -> DataFrame:
        """The indicator table with a row for each site behind an indicator and year."""
        return op.indicator_members(self.site_years, self.indicators, self.rules)

    def _published(self, df: DataFrame, headers: dict[str, str]) -> DataFrame:
        rounded = published.round_numbers(df).orderBy(*self.rules.keys(df), "year")
        return published.with_headers(rounded, headers, self.rules.base_year)

    def flagged(self) -> DataFrame:
        """Site-years with the flags of the cohorts they count in, for keeping: nothing that starts from them needs the
        cohort windows again."""
        return op.with_counting_flags(self.site_years, self.rules)

    def saved_in(self, folder: str) -> Assessment:
        """Write site-years, then the profile made from them, and go on from the written tables.

        What is read from ``folder`` cannot be saved there: a lost executor would find its input gone.
        """
        spark = self.site_years.sparkSession
        folder = folder.rstrip("/")
        if any(f"{folder}/" in path for path in self.site_years.inputFiles()):
            raise ValueError(f"the site-years are read from {folder}; save them in another folder")
        saved.save_frame(self.flagged(), f"{folder}/site_years")
        site_years = saved.load_site_years(spark, f"{folder}/site_years", self.rules.series)
        saved.save_frame(op.indicator_profile(site_years, self.rules), f"{folder}/profile")
        return Assessment(self.rules, self.stations, site_years, saved.load_frame(spark, f"{folder}/profile"))

    def saved_as_tables(self, name: str, buckets: int) -> Assessment:
        """Like :meth:`saved_in`, as catalog tables ``<name>_site_years`` and ``<name>_stations``, bucketed and sorted by site,
        and ``<name>_profile``.  Everything by site then works where the rows lie: after the write no site-year moves, also
        not for the site table, whose windows and joins all go by site."""
        spark = self.site_years.sparkSession
        site_years, stations, profile = (f"{name}_{part}" for part in ("site_years", "stations", "profile"))
        saved.save_bucketed(self.flagged(), site_years, buckets)
        saved.save_bucketed(self.stations, stations, buckets)
        kept = spark.table(site_years)
        op.indicator_profile(kept, self.rules).write.mode("overwrite").saveAsTable(profile)
        return Assessment(self.rules, spark.table(stations), kept, spark.table(profile))

    def publish(self, data_folder: str, tables_folder: str) -> Assessment:
        """Write everything: frames for later jobs to ``data_folder``, tables for readers to ``tables_folder``."""
        data, tables = data_folder.rstrip("/"), tables_folder.rstrip("/")
        done = self.saved_in(data)
        saved.save_frame(done.bounds, f"{data}/summary_bounds")
        saved.save_frame(done.absolute, f"{data}/summary_absolute")
        saved.save_frame(done.indicators, f"{data}/indicators")
        saved.save_frame(done.members, f"{data}/indicator_members")
        published.write_csv(done.published_bounds(), f"{tables}/summary_bounds")
        published.write_csv(done.published_absolute(), f"{tables}/summary_absolute")
        indicators, keys = done.published_indicators(), self.rules.keys(done.indicators)
        published.write_csv(indicators, f"{tables}/indicator_data", (*keys, *op.indicator_order(), "site"))
        published.write_tables(
            {
                "sites_to_include": (done.included, (*keys, "year", "site")),
                "site_data": (done.site_detail, (*[k for k in keys if k in done.site_detail.columns], "year", "site")),
                "data_capture_statistics": (
                    published.with_headers(done.capture_statistics, published.CAPTURE_HEADERS),
                    (*keys, "year"),
                ),
            },
            f"{tables}/data_for_modelling",
            fmt="csv",
        )
        return done

    def publish_version(self, root: str) -> str:
        """:meth:`publish` as one unit, into ``data`` and ``tables`` of a new version below ``root`` (see
        ``sources.versions``); readers see all of it, or the former version.  Returns the version's folder."""
        spark = self.site_years.sparkSession
        return versions.publish_version(spark, root, lambda folder: self.publish(f"{folder}/data", f"{folder}/tables"))


def assess(
    readings: DataFrame,
    stations: DataFrame,
    rules: Rules,
    exceptions: DataFrame | None = None,
    renames: DataFrame | None = None,
) -> Assessment:
    """Plan an assessment of selected readings (``sources.select_readings``) and a station register.

    ``exceptions`` and ``renames`` are tables in place of the entries of ``rules``; see ``operators.stations``.
    """
    return assess_annual(op.annual_site_stats(readings, rules), stations, rules, exceptions, renames)


def assess_annual(
    annual: DataFrame,
    stations: DataFrame,
    rules: Rules,
    exceptions: DataFrame | None = None,
    renames: DataFrame | None = None,
) -> Assessment:
    """Plan an assessment from annual statistics per site.

    Readings may carry a compact site key; the annual statistics, of which there are thousands of times fewer, are then
    the place to put the names that the register uses.
    """
    register = op.clean_stations(stations, rules, renames)
    site_years = op.eligible_site_years(op.operational_site_years(annual, register, rules), rules, exceptions)
    return Assessment(rules, register, site_years, op.indicator_profile(site_years, rules))
