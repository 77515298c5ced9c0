"""Tables for readers: rounded, under display headers, as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published headers.
BOUNDS_HEADERS = {
    "year": "Year",
    "PEI": "PEI (µg/m³)",
    "ci_PEI_lower": "Lower bound - 95% confidence interval for PEI (µg/m³)",
    "ci_PEI_upper": "Upper bound - 95% confidence interval for PEI (µg/m³)",
    "delta_PEI": "Year-on-year change in PEI (µg/m³)",
    "ci_delta_PEI_lower": "Lower bound - 95% confidence interval for year-on-year change (µg/m³)",
    "ci_delta_PEI_upper": "Upper bound - 95% confidence interval for year-on-year change (µg/m³)",
    "delta_PEI_cumulative": "Total change in PEI since 2018 (µg/m³)",
    "ci_delta_PEI_cumulative_lower": "Lower bound - 95% confidence interval for total change (µg/m³)",
    "ci_delta_PEI_cumulative_upper": "Upper bound - 95% confidence interval for total change (µg/m³)",
    "perc_change": "Total change in PEI since 2018 (%)",
    "ci_perc_change_lower": "Lower bound - 95% confidence interval for percent change (%)",
    "ci_perc_change_upper": "Upper bound - 95% confidence interval for percent change (%)",
}
ABSOLUTE_HEADERS = {
    "year": "Year",
    "PEI": "PEI (µg/m³)",
    "ci_PEI": "+/- 95% confidence interval for PEI (µg/m³)",
    "delta_PEI": "Year-on-year change in PEI (µg/m³)",
    "ci_delta_PEI": "+/- 95% confidence interval for year-on-year change (µg/m³)",
    "delta_PEI_cumulative": "Total change in PEI since 2018 (µg/m³)",
    "ci_delta_PEI_cumulative": "+/- 95% confidence interval for total change (µg/m³)",
    "perc_change": "Total change in PEI since 2018 (% unrounded)",
    "ci_perc_change": "+/- 95% confidence interval for percent change (% unrounded)",
}
CAPTURE_HEADERS = {
    "total_sites": "total sites",
    "sites_meeting_threshold": "sites meeting data capture threshold",
    "percent_meeting_threshold": "percent meeting data capture threshold",
}


def round_numbers(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating-point column (ties to even), which also clears the noise of sums of rounded values."""
    return df.select(
        *[
            F.bround(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def with_headers(df: DataFrame, headers: dict[str, str], base_year: int = 2018) -> DataFrame:
    """Rename to display headers; columns without one, such as series keys, keep their name.

    The headers mention the base year, so another base year replaces it there.
    """
    names = {c: headers.get(c, c).replace("2018", str(base_year)) for c in df.columns}
    return df.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()])


def write_csv(df: DataFrame, path: str, order: tuple = ()) -> None:
    """UTF-8 CSV with a header line in every part file; rows in ``order`` through all files."""
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_tables(tables: dict[str, tuple[DataFrame, tuple]], folder: str, fmt: str = "parquet") -> None:
    """Several named tables under one folder, each in its order: the distributed form of a workbook with sheets."""
    for name, (df, order) in tables.items():
        df = df.orderBy(*order) if order else df
        df.write.mode("overwrite").option("header", True).format(fmt).save(f"{folder.rstrip('/')}/{name}")
