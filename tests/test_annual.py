from dataclasses import replace

import pyarrow.parquet as pq
import pytest
from frames import one, plan_of, rows_of
from pyspark.sql import functions as F

from breathline import Rules
from breathline.operators import annual_site_stats
from breathline.schemas import READINGS, STANDARD_READINGS
from breathline.sources import (
    accepted,
    checked_readings,
    conform_readings,
    read_readings,
    rejected,
    select_readings,
    write_readings,
)

RULES = Rules()


def readings(spark, rows):
    """Rows are (site, year, value[, measurement[, averaging[, pollutant]]])."""
    full = [(*r, *("Hourly", "None", "PM2.5")[len(r) - 3 :]) for r in rows]
    return spark.createDataFrame([(s, y, None, v, m, a, p) for s, y, v, m, a, p in full], READINGS)


def stats(spark, rows, rules=RULES):
    return annual_site_stats(select_readings(readings(spark, rows), rules), rules)


def test_mean_error_and_capture(spark):
    row = one(stats(spark, [("A", 2019, 1.0), ("A", 2019, 3.0), ("A", 2019, None)]))
    assert row["mean"] == 2.0
    assert row["se_sampling_within_site"] == pytest.approx(2**0.5 / 2**0.5)
    assert row["capture"] == pytest.approx(100 * 2 / 8760)


def test_full_leap_year_of_hours(spark):
    df = spark.range(8784).selectExpr("'A' AS site", "2020 AS year", "'Hourly' AS measurement", "1D AS value")
    assert one(annual_site_stats(df, RULES))["capture"] == 100.0


def test_centuries_are_leap_years_too(spark):
    df = spark.range(366).selectExpr("'A' AS site", "2100 AS year", "'Daily' AS measurement", "1D AS value")
    assert one(annual_site_stats(df, RULES))["capture"] == 100.0


def test_year_without_valid_readings(spark):
    row = one(stats(spark, [("A", 2019, None), ("A", 2019, None)]))
    assert (row["mean"], row["se_sampling_within_site"], row["capture"]) == (None, None, 0.0)


def test_nan_is_a_missing_reading(spark):
    row = one(stats(spark, [("A", 2019, float("nan")), ("A", 2019, 4.0)]))
    assert row["mean"] == 4.0
    assert row["capture"] == pytest.approx(100 / 8760)


def test_single_reading_has_no_error(spark):
    row = one(stats(spark, [("A", 2019, 4.0)]))
    assert (row["mean"], row["se_sampling_within_site"]) == (4.0, None)


def test_measurement_error_adds_in_quadrature(spark):
    rules = replace(RULES, measurement_error=0.5)
    row = one(stats(spark, [("A", 2019, 1.0), ("A", 2019, 3.0)], rules))
    assert row["se_sampling_within_site"] == pytest.approx((1 + 1) ** 0.5)


def test_instruments_are_separate(spark):
    df = stats(spark, [("A", 2019, 1.0), ("A", 2019, 5.0, "Daily")])
    assert rows_of(df, "measurement", "mean") == [("Daily", 5.0), ("Hourly", 1.0)]


def test_selection(spark):
    df = select_readings(
        readings(
            spark,
            [
                ("in", 2009, 1.0),
                ("early", 2008, 1.0),
                ("averaged", 2010, 1.0, "Hourly", "24h"),
                ("daily", 2010, 1.0, "Daily", "24h"),
                ("other", 2010, 1.0, "Hourly", "None", "NO2"),
                ("neither", 2010, 1.0, "Weekly"),
            ],
        ),
        RULES,
    )
    assert rows_of(df, "site") == [("daily",), ("in",)]


def test_many_series_at_once(spark):
    rules = replace(RULES, series=("pollutant",), pollutant=None)
    df = stats(spark, [("A", 2019, 1.0), ("A", 2019, 9.0, "Hourly", "None", "NO2")], rules)
    assert rows_of(df, "pollutant", "site", "mean") == [("NO2", "A", 9.0), ("PM2.5", "A", 1.0)]


def test_scan_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "readings")
    readings(spark, [("A", 2019, 1.0), ("B", 2001, 1.0)]).write.partitionBy("year").parquet(path)
    df = annual_site_stats(read_readings(spark, path, RULES), RULES)
    assert rows_of(df, "site") == [("A",)]
    plan = plan_of(df)
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "EqualTo(pollutant,PM2.5)" in plan
    assert "date" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_conform(spark):
    df = spark.createDataFrame([("x", 1.5, "R", 2019, "S")], "extra STRING, poll_index DOUBLE, qc STRING, year INT, site STRING")
    out = conform_readings(df)
    assert out.schema.names == STANDARD_READINGS.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in STANDARD_READINGS]
    row = one(out)
    assert (row["value"], row["ratified"], row["year"], row["site"], row["zone"]) == (1.5, "R", 2019, "S", None)


def test_conform_keeps_the_first_of_two_names(spark):
    df = spark.createDataFrame([("new", "old")], "ratified STRING, qc STRING")
    assert one(conform_readings(df))["ratified"] == "new"
    assert one(conform_readings(df.select("qc", "ratified")))["ratified"] == "old"


def test_bad_values_are_rejected_with_reasons(spark):
    rows = [("A", "2019", "1.5", "PM2.5"), ("B", "20x9", "1,5", "PM2.5"), ("C", "2019", None, None), (None, "2019", "2", "PM2.5")]
    df = spark.createDataFrame(rows, "site STRING, year STRING, poll_index STRING, pollutant STRING")
    checked = checked_readings(df, ("site", "year", "pollutant"))
    assert checked.columns == [*STANDARD_READINGS.names, "faults"]
    good = accepted(checked)
    assert [f.dataType for f in good.schema] == [f.dataType for f in STANDARD_READINGS]
    assert rows_of(good, "site", "year", "value") == [("A", 2019, 1.5)]
    assert {r.site: r.faults for r in rejected(checked).collect()} == {
        "B": ["year: 20x9", "value: 1,5"],
        "C": ["pollutant: missing"],
        None: ["site: missing"],
    }
    # a required column that is not there at all; an empty frame
    assert accepted(checked_readings(df, ("network",))).count() == 0
    assert checked_readings(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        conform_readings(df).collect()


def test_written_readings_are_pruned_by_folder_and_row_group(spark, tmp_path):
    path = str(tmp_path / "readings")
    df = spark.range(200_000).selectExpr(
        "concat('site', lpad(id % 1000, 4, '0')) AS site",
        "int(2015 + id % 3) AS year",
        "timestamp_ntz '2015-01-01 00:00:00' + make_dt_interval(0, id) AS date",
        "double(id % 11) AS value",
        "'Hourly' AS measurement",
        "'None' AS averaging",
        "if(id % 5 = 0, 'NO2', 'PM2.5') AS pollutant",
    )
    before = spark.sparkContext._jsc.hadoopConfiguration().get("parquet.block.size")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(64 << 10))
    try:
        write_readings(df, path)
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        conf.unset("parquet.block.size") if before is None else conf.set("parquet.block.size", before)
    read = read_readings(spark, path, replace(RULES, first_year=2017))
    assert read.count() == df.where("year >= 2017 AND pollutant = 'PM2.5'").count()
    files = [r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()]
    assert files and all("pollutant=PM2.5/year=2017" in f for f in files)
    plan = plan_of(read)
    assert "PartitionFilters: [isnotnull(pollutant" in plan or "isnotnull(year" in plan.split("PartitionFilters")[1][:200]
    # in every file sites come in order, and few row groups can hold any one of them
    groups = overlapping = 0
    for file in (tmp_path / "readings").rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("site")
        ranges = [(s.min, s.max) for s in (meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups))]
        assert ranges == sorted(ranges) and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
        groups += len(ranges)
        overlapping += sum(low <= "site0500" <= high for low, high in ranges)
    assert groups > 20 and overlapping < groups / 4
    assert "EqualTo(site,site0500)" in plan_of(read.where("site = 'site0500'"))
