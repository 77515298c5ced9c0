import json
from dataclasses import replace

import duckdb
import pytest
from frames import plan_of, rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
import run
from breathline.functions.files import qualified
from breathline.functions.lineage import materialise, shared_folder
from breathline.operators import annual_site_stats, clean_stations, indicator_profile, reduction_summary
from breathline.plans import Assessment, assess
from breathline.plans.analysis import analyse, analyse_saved
from breathline.sources import load_frame, load_site_years, read_stations, select_readings
from breathline.sources.published import ABSOLUTE_HEADERS, BOUNDS_HEADERS, round_numbers, with_headers
from breathline.sources.saved import save_bucketed
from breathline.sources.star_schema import SALES_RULES, name_sites, sales_readings, sales_stations

DATA = "/root/testdata/sf0.001"


def planned_readings(spark):
    return select_readings(sales_readings(spark, DATA), SALES_RULES)


@pytest.fixture(scope="module")
def planned(spark):
    return assess(planned_readings(spark), sales_stations(spark, DATA), SALES_RULES)


@pytest.fixture(scope="module")
def published(planned, tmp_path_factory):
    folder = tmp_path_factory.mktemp("assessment")
    planned.publish(f"{folder}/data", f"{folder}/tables")
    return folder


def csv(path):
    return duckdb.connect().sql(f"SELECT * FROM read_csv('{path}/*.csv', header = true)")


def test_saved_frames_hold_the_results(spark, planned, published):
    for name, frame in [
        ("site_years", planned.flagged()),
        ("profile", planned.profile),
        ("summary_bounds", planned.bounds),
        ("summary_absolute", planned.absolute),
        ("indicators", planned.indicators),
        ("indicator_members", planned.members),
    ]:
        saved = load_frame(spark, f"{published}/data/{name}")
        assert [f.name for f in saved.schema] == [f.name for f in frame.schema]
        assert rows_of(round_numbers(saved, 9)) == rows_of(round_numbers(frame, 9)), name


def test_published_csv(published, planned):
    bounds = csv(f"{published}/tables/summary_bounds")
    assert bounds.columns == [h.replace("2018", "1997") for h in BOUNDS_HEADERS.values()]
    assert [r[0] for r in bounds.fetchall()] == [1997, 1998, 1999, 2000, 2001]
    absolute = csv(f"{published}/tables/summary_absolute")
    assert absolute.columns == [h.replace("2018", "1997") for h in ABSOLUTE_HEADERS.values()]
    indicators = csv(f"{published}/tables/indicator_data")
    assert indicators.columns == ["indicator", "year", "site", "mean", "se_total", "n_sites"]
    rows = indicators.fetchall()
    assert len(rows) == planned.published_indicators().count()
    order = [(r[0] != "PEI base", r[0][-4:], not r[0].startswith("RI"), r[1], r[2]) for r in rows]
    assert order == sorted(order)


def test_tables_for_modelling(published):
    folder = f"{published}/tables/data_for_modelling"
    included = csv(f"{folder}/sites_to_include").fetchall()
    assert [(r[0], r[2]) for r in included] == sorted((r[0], r[2]) for r in included)
    sizes = {r[0]: r[1] for r in included}
    assert len(included) == sum(sizes.values())
    detail = csv(f"{folder}/site_data")
    at = [detail.columns.index(c) for c in ("year", "site")]
    rows = [tuple(r[i] for i in at) for r in detail.fetchall()]
    assert len(rows) >= len(included) and rows == sorted(rows)
    assert csv(f"{folder}/data_capture_statistics").columns == [
        "year",
        "total sites",
        "sites meeting data capture threshold",
        "percent meeting data capture threshold",
    ]


def test_analysis_of_saved_frames(spark, planned, published):
    saved = analyse_saved(spark, f"{published}/data", SALES_RULES)
    live = analyse(planned.profile, planned.indicators, planned.absolute, SALES_RULES)
    for name in ("edges", "turnover", "core", "decomposed", "simplified", "relative_error", "site_counts"):
        assert rows_of(round_numbers(getattr(saved, name), 9)) == rows_of(round_numbers(getattr(live, name), 9)), name


def test_command_line(spark, tmp_path):
    sales_readings(spark, DATA).write.parquet(str(tmp_path / "readings"))
    sales_stations(spark, DATA).write.option("header", True).csv(str(tmp_path / "stations"))
    rules = {
        "first_year": None,
        "readings_per_day": {"Hourly": 0.25, "Daily": 0.25},
        "excluded_zones": "AFRICA",
        "base_window": [1995, 1997],
        "base_year": 1997,
        "statistics_from": 1995,
    }
    (tmp_path / "rules.json").write_text(json.dumps(rules))
    common = ["--data", f"{tmp_path}/data", "--rules", f"{tmp_path}/rules.json", "--tables"]
    source = ["--readings", f"{tmp_path}/readings", "--stations", f"{tmp_path}/stations", "--stations-format", "csv"]
    run.main(["assess", *source, *common, f"{tmp_path}/tables"])
    run.main(["analyse", *common, f"{tmp_path}/analysis"])
    deltas = csv(f"{tmp_path}/tables/summary_absolute").fetchall()
    assert [r[3] for r in deltas] == [None, 0.06, -0.22, -0.35, 0.46]
    assert len(csv(f"{tmp_path}/analysis/relative_error").fetchall()) == 1
    edges = csv(f"{tmp_path}/analysis/edges").fetchall()
    assert [(r[0] != "PEI base", r[1], r[0]) for r in edges] == sorted((r[0] != "PEI base", r[1], r[0]) for r in edges)


def test_stations_from_csv(spark, tmp_path):
    stations = sales_stations(spark, DATA)
    stations.write.option("header", True).csv(str(tmp_path / "stations"))
    assert rows_of(read_stations(spark, str(tmp_path / "stations"), "csv")) == rows_of(stations)


def test_headers_keep_series_keys(spark):
    df = spark.createDataFrame([("N", 2018, 1.234)], "zone STRING, year INT, PEI DOUBLE")
    assert with_headers(round_numbers(df), BOUNDS_HEADERS).first().asDict() == {
        "zone": "N",
        "Year": 2018,
        "PEI (µg/m³)": 1.23,
    }


def test_materialised_table_lives_in_the_shared_folder(spark):
    df = spark.range(5)
    again = materialise(df)
    assert again.inputFiles()[0].startswith(f"file://{shared_folder(spark)}")
    assert rows_of(again) == rows_of(df)


def test_folders_without_a_scheme_are_in_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert qualified(spark, "/shared/x") == "file:/shared/x"
    try:
        conf.set("fs.defaultFS", "hdfs://127.0.0.1:1")
        assert qualified(spark, "/shared/x") == "hdfs://127.0.0.1:1/shared/x"
    finally:
        conf.set("fs.defaultFS", before)


class Cluster:
    """As much of a session as the choice of the shared folder looks at, on a cluster."""

    def __init__(self, spark, **settings):
        self.conf = {"spark.sql.warehouse.dir": "/tmp/warehouse"} | settings
        self.sparkContext = self
        self.master, self.applicationId = "spark://host:7077", "app"
        self._jvm, self._jsc = spark.sparkContext._jvm, spark.sparkContext._jsc


def test_a_cluster_needs_a_shared_folder(spark):
    assert shared_folder(Cluster(spark, **{"spark.checkpoint.dir": "/mnt/shared/"})) == "/mnt/shared/breathline/app"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster(spark))
    away = Cluster(spark, **{"spark.sql.warehouse.dir": "hdfs://127.0.0.1:1/warehouse"})
    assert shared_folder(away) == "hdfs://127.0.0.1:1/warehouse/breathline/app"


def test_a_frame_is_not_saved_over_its_own_source(spark, published):
    data = f"{published}/data"
    again = assess_annual_saved(spark, data)
    with pytest.raises(ValueError, match="another folder"):
        again.saved_in(data)


def assess_annual_saved(spark, data):
    site_years = load_site_years(spark, f"{data}/site_years")
    stations = clean_stations(sales_stations(spark, DATA), SALES_RULES)
    return Assessment(SALES_RULES, stations, site_years, indicator_profile(site_years, SALES_RULES))


def test_sites_of_long_keys_stay_apart_and_unlisted_suppliers_are_none(spark, tmp_path):
    keys = [1234567890, 1234567891, 12345678901]
    suppliers = [(k, f"Works {k}", 1) for k in keys]
    spark.createDataFrame(suppliers, "s_suppkey LONG, s_name STRING, s_nationkey INT").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(k, 1, float(i), 0.1, 0.1, "1996-05-01") for i, k in enumerate([*keys, 4, None])]
    schema = "l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_shipdate STRING"
    df = spark.createDataFrame(lines, schema).withColumn("l_shipdate", F.expr("CAST(l_shipdate AS TIMESTAMP_NTZ)"))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    named = sales_readings(spark, str(tmp_path))
    assert sorted({r.site for r in named.collect()}) == sorted(f"Works {k}" for k in keys)
    later = annual_site_stats(select_readings(sales_readings(spark, str(tmp_path), named=False), SALES_RULES), SALES_RULES)
    annual = annual_site_stats(select_readings(named, SALES_RULES), SALES_RULES)
    assert rows_of(name_sites(later, spark, str(tmp_path))) == rows_of(annual)


# plans -----------------------------------------------------------------------------------------------------------


def exchanges(plan):
    tree = plan[: plan.index("\n\n")]
    return tree.count("- Exchange (") + tree.count("- BroadcastExchange (")


def test_summary_plan(spark, planned):
    plan = plan_of(planned.summary)
    assert plan.count("lineitem.parquet") == 1
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_discount:double,l_tax:double,l_shipdate" in plan
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert forbidden not in plan
    # readings are condensed before their only shuffle; site-years then move once, to be laid out by site
    moved = [line for line in plan.split("\n") if line.startswith("Arguments: hashpartitioning(site")]
    assert len(moved) == 3  # annual groups, site-years, register


def test_years_bound_the_scan(spark):
    pushed = [line for line in plan_of(entry.scan_filtered_readings(spark, DATA)).split("\n") if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(l_shipdate" in line for line in pushed)
    pushed = [line for line in plan_of(entry.pei_base(spark, DATA)).split("\n") if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(l_shipdate" in line and "LessThan(l_shipdate" in line for line in pushed)


def test_simplified_reduction_needs_no_cohorts(spark):
    assert "RangeFrame" not in plan_of(entry.simplified_reduction(spark, DATA))


def test_flagged_site_years_need_no_cohort_windows(spark, published):
    again = assess_annual_saved(spark, f"{published}/data")
    for frame in (again.profile, again.published_indicators(), again.included, again.site_detail):
        assert "RangeFrame" not in plan_of(frame)


def test_results_do_not_depend_on_the_settings(spark, planned):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    with_settings = rows_of(round_numbers(planned.summary, 9))
    try:
        spark.conf.set(name, "true")
        again = assess(planned_readings(spark), sales_stations(spark, DATA), SALES_RULES).summary
        assert rows_of(round_numbers(again, 9)) == with_settings
    finally:
        spark.conf.set(name, "false")


def test_saved_site_years_move_once(spark, published):
    site_years = load_site_years(spark, f"{published}/data/site_years")
    plan = plan_of(reduction_summary(indicator_profile(site_years, SALES_RULES), SALES_RULES))
    assert len([x for x in plan.split("\n") if x.startswith("Arguments: hashpartitioning(site")]) == 1


def test_bucketed_site_years_do_not_move_at_all(spark, planned):
    save_bucketed(planned.site_years, "site_years_by_site", 4)
    df = spark.table("site_years_by_site")
    profile = indicator_profile(df, SALES_RULES)
    assert "hashpartitioning(site" not in plan_of(profile)
    assert rows_of(round_numbers(profile, 9)) == rows_of(round_numbers(planned.profile, 9))


def test_site_detail_of_bucketed_tables_moves_no_site_year(spark, planned):
    wanted = rows_of(round_numbers(planned.site_detail, 9))
    buckets = 6
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) != buckets
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)  # merge joins wherever a size is checked, as for tables of any size
    try:
        done = planned.saved_as_tables("detail", buckets)
        plan = plan_of(done.site_detail)
        assert "hashpartitioning(site" not in plan and f"SelectedBucketsCount: {buckets} out of {buckets}" in plan
        assert rows_of(round_numbers(done.site_detail, 9)) == wanted
        assert rows_of(round_numbers(done.profile, 9)) == rows_of(round_numbers(planned.profile, 9))
    finally:
        spark.conf.set(name, before)


def test_bucketed_tables_of_several_series(spark):
    planned = assess(planned_readings(spark), sales_stations(spark, DATA), replace(SALES_RULES, series=("zone",)))
    done = planned.saved_as_tables("detail_by_zone", 3)
    assert rows_of(round_numbers(done.site_detail, 9)) == rows_of(round_numbers(planned.site_detail, 9))


def test_bucketed_readings_are_aggregated_and_laid_out_in_place(spark):
    readings = planned_readings(spark)
    save_bucketed(readings, "readings_by_site", 4)
    annual = annual_site_stats(spark.table("readings_by_site"), SALES_RULES)
    assert exchanges(plan_of(annual)) == 0
    assert rows_of(round_numbers(annual, 9)) == rows_of(round_numbers(annual_site_stats(readings, SALES_RULES), 9))


def test_a_hot_site_is_condensed_before_the_shuffle(spark):
    """One site holds a third of all readings; what is shuffled is a few rows per task all the same."""
    readings = spark.range(0, 300_000, 1, 6).selectExpr(
        "if(id % 3 = 0, 'hot', concat('s', id % 50)) AS site",
        "2019 AS year",
        "'Hourly' AS measurement",
        "double(id % 7) AS value",
    )
    annual = annual_site_stats(readings, SALES_RULES)
    assert annual.where("site = 'hot'").first().capture == pytest.approx(100_000 / (365 * 0.25) * 100)
    # operators are listed bottom up: a partial aggregate, the exchange, the final one
    details = plan_of(annual)
    assert 0 < details.index("partial_avg(value") < details.index("Arguments: hashpartitioning(site")
