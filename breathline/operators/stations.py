"""Station register, and the rules that decide which site-years may enter an indicator."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..functions.sql import text
from ..rules import OPEN_ENDED, Rules
from ..schemas import STATIONS

# The register's columns, with the instrument in place of the variable it measures.
REGISTER_COLUMNS = tuple("measurement" if name == "variable" else name for name in STATIONS.names)


def _year_of(date: str) -> str:
    return f"year(try_to_date(left({date}, 10), 'yyyy-MM-dd'))"


def exception_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """``Rules.site_exceptions`` as rows of ``site, first_year``."""
    sites, years = [*rules.site_exceptions], [*rules.site_exceptions.values()]
    return spark.createDataFrame(pa.table({"site": pa.array(sites, pa.string()), "first_year": pa.array(years, pa.int32())}))


def rename_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """``Rules.renamed_sites`` as rows of ``site, current``."""
    old, new = [*rules.renamed_sites], [*rules.renamed_sites.values()]
    return spark.createDataFrame(pa.table({"site": pa.array(old, pa.string()), "current": pa.array(new, pa.string())}))


def clean_stations(stations: DataFrame, rules: Rules, renames: DataFrame | None = None) -> DataFrame:
    """Distinct register rows of the wanted instruments, under current site names, with start and end years.

    An open-ended station has a NULL end year.  ``renames`` (``site, current``) replaces the renamed sites of ``rules``; of
    several rows for one site the name that sorts last counts, and names are looked up once, not one through another.
    """
    keys = [k for k in rules.keys(stations) if k not in REGISTER_COLUMNS]
    instruments = " ".join(f"WHEN {text(v)} THEN {text(name)}" for v, name in rules.station_variables.items())
    kept = (
        stations.where(F.col("variable").isin(*rules.station_variables))
        .withColumn("measurement", F.expr(f"CASE variable {instruments} END"))
        .select(*keys, *REGISTER_COLUMNS)
        .distinct()
    )
    if renames is not None:
        renames = renames.groupBy("site").agg(F.max("current").alias("current"))
    elif rules.renamed_sites:
        renames = rename_table(stations.sparkSession, rules)
    if renames is not None:
        found = renames.select(F.col("site").alias("_old"), F.col("current").alias("_new"))
        site = F.coalesce("_new", "site").alias("site")
        joined = kept.join(found, F.col("site") == F.col("_old"), "left")
        kept = joined.select(*[site if c == "site" else F.col(c) for c in kept.columns])
    return kept.withColumns(
        {
            "start_date": F.expr(_year_of("string(start_date)")),
            "end_date": F.expr(_year_of(f"nullif(string(end_date), '{OPEN_ENDED}')")),
        }
    )


def operational_site_years(site_years: DataFrame, stations: DataFrame, rules: Rules) -> DataFrame:
    """Add what the register says about each site-year; see :func:`clean_stations`.

    ``operational_all_year`` needs a start in an earlier and an end in a later year (or none).  A site-year without a
    register row keeps NULLs.  Several register rows for one instrument repeat the site-year, as in any left join.

    Site-years are laid out by site, and the register, which grows with the number of sites, is brought to them by a
    merge join.  That layout then serves the windows of the cohort and instrument rules as well, so this is the only
    time site-years move.
    """
    shared = [k for k in rules.keys(site_years) if k in stations.columns]
    brought = [k for k in rules.keys(stations) if k not in shared]
    names = dict.fromkeys([*shared, *brought, "site", "measurement", "site_type", "zone", "start_date", "end_date"])
    return (
        site_years.repartition(*shared, "site")
        .join(stations.select(*names).hint("merge"), [*shared, "site", "measurement"], "left")
        .withColumn(
            "operational_all_year", F.expr("start_date < year AND (end_date IS NULL OR end_date > year)")
        )
    )


def eligible_site_years(site_years: DataFrame, rules: Rules, exceptions: DataFrame | None = None) -> DataFrame:
    """Site-years that may enter an indicator, with capture rounded to whole percent before it is judged.

    An unknown zone or site type excludes a site-year.  ``exceptions`` (``site, first_year``) replaces the exceptions of
    ``rules``: a site's years before its first year are out; of several rows for a site the latest first year counts.  They
    are one anti-join however many there are, on the site alone, by which site-years lie already.
    """
    kept = site_years.withColumn("capture", F.expr(half_up("capture"))).where(
        (F.col("capture") > 0)
        & ~F.col("zone").rlike(rules.excluded_zones)
        & F.col("site_type").isin(*rules.site_types)
    )
    if exceptions is None and rules.site_exceptions:
        exceptions = exception_table(site_years.sparkSession, rules)
    if exceptions is None:
        return kept
    bounds = exceptions.select(F.col("site").alias("_site"), F.col("first_year").alias("_first_year"))
    early = (F.col("site") == F.col("_site")) & (F.col("year") < F.col("_first_year"))
    return kept.join(bounds, early, "left_anti")
