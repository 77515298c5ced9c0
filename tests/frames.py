"""Small hand-made frames."""

from __future__ import annotations

from breathline.schemas import SITE_YEARS

SITE_YEAR_COLUMNS = [f.name for f in SITE_YEARS]
SITE_YEAR_DEFAULTS = {
    "site": "A",
    "year": 2018,
    "mean": 10.0,
    "se_sampling_within_site": 0.1,
    "capture": 95.0,
    "measurement": "Hourly",
    "site_type": "Urban Background",
    "zone": "London",
    "start_date": 2000,
    "end_date": None,
    "operational_all_year": True,
}


def site_years(spark, rows):
    """A site-year frame from dicts that name only what matters."""
    return spark.createDataFrame(
        [tuple({**SITE_YEAR_DEFAULTS, **r}[c] for c in SITE_YEAR_COLUMNS) for r in rows], SITE_YEARS
    )


def rows_of(df, *columns, order=None):
    columns = columns or tuple(df.columns)
    found = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(found, key=order or (lambda t: tuple((v is None, str(v)) for v in t)))


def one(df):
    (row,) = df.collect()
    return row.asDict()


def plan_of(df):
    """The physical plan with its details, as ``explain("formatted")`` prints it."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)
