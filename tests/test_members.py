from dataclasses import replace

from frames import one, plan_of, rows_of, site_years
from pyspark.sql import functions as F
from test_indicators import random_rows

from breathline import Rules
from breathline.operators import (
    annual_members,
    capture_statistics,
    fullest_indicator,
    included_detail,
    indicator_profile,
    indicator_members,
    indicator_table,
    population_indicator,
    site_detail,
    sites_to_include,
    split_list,
)
from breathline.schemas import STATIONS

RULES = Rules()
TABLE = "indicator STRING, year INT, mean DOUBLE, se_total DOUBLE, n_sites BIGINT"


def test_most_sites_wins_and_ties_go_to_base_then_early_then_ri(spark):
    rows = [
        ("PEI base", 2018, 5),
        ("RI 2019", 2018, 5),
        ("PEI 2020", 2019, 4),
        ("RI 2020", 2019, 4),
        ("PEI 2019", 2019, 4),
        ("RI 2021", 2020, 3),
        ("PEI 2020", 2020, 3),
        ("PEI 2021", 2020, 4),
        ("PEI 2022", 2021, 7),
        ("RI 2022", 2021, 7),
    ]
    df = spark.createDataFrame([(i, y, 1.0, 1.0, n) for i, y, n in rows], TABLE)
    assert rows_of(fullest_indicator(df, RULES), "year", "indicator", "n_sites") == [
        (2018, "PEI base", 5),
        (2019, "PEI 2019", 4),
        (2020, "PEI 2021", 4),
        (2021, "RI 2022", 7),
    ]


def test_text_lists_of_older_tables_split_into_rows(spark):
    lists = spark.createDataFrame([(2018, "A; a;b"), (2019, "c")], "year INT, sites STRING")
    assert rows_of(split_list(lists, "sites", "site")) == [(2018, "A"), (2018, "a"), (2018, "b"), (2019, "c")]


def test_members_are_one_row_per_site_at_any_size(spark):
    few = site_years(spark, random_rows(31))
    many = few.crossJoin(spark.range(30)).withColumn("site", F.concat("site", F.lit(" "), "id")).drop("id")
    for df in (few, many):
        table = indicator_table(indicator_profile(df, RULES), RULES)
        members = indicator_members(df, table, RULES)
        assert members.columns == ["indicator", "year", "site", "mean", "se_total", "n_sites"]
        assert members.count() == members.select("indicator", "year", "site").distinct().count()
        counted = members.groupBy("indicator", "year", "n_sites").count()
        assert counted.count() == table.count()
        # n_sites counts rows, and a repeated register row repeats the site-years of its site
        assert counted.where("count > n_sites").count() == 0
        assert counted.where("count < n_sites").count() > 0
        assert rows_of(members.groupBy("indicator", "year").count()) == rows_of(
            indicator_members(df.distinct(), table, RULES).groupBy("indicator", "year").count()
        )
        assert "CollectSet(site" not in plan_of(members) and "collect_set(site" not in plan_of(members)


def test_annual_members_match_the_counts(spark):
    df = site_years(spark, [r for r in random_rows(32) if "start_date" not in r])
    yearly = population_indicator(df, RULES)
    members = annual_members(df, yearly, RULES)
    assert rows_of(members.groupBy("year").count()) == rows_of(yearly.select("year", "n_sites"))


def test_sites_per_year_is_the_fullest_indicator(spark):
    df = site_years(spark, random_rows(33))
    table = indicator_table(indicator_profile(df, RULES), RULES)
    included = sites_to_include(df, table, RULES)
    fullest = fullest_indicator(table, RULES)
    assert rows_of(included.select("year", "n_sites").distinct()) == rows_of(fullest.select("year", "n_sites"))
    counted = included.groupBy("year", "n_sites").count()
    assert counted.where("count > n_sites").count() == 0
    # a repeated register row counts once more in n_sites, but is no further site
    assert counted.where("count < n_sites").count() > 0
    assert included.count() == included.select("year", "site").distinct().count()


def test_without_repeated_register_rows_sites_and_rows_agree(spark):
    df = site_years(spark, random_rows(33)).dropDuplicates(["site", "year", "measurement"])
    table = indicator_table(indicator_profile(df, RULES), RULES)
    members = indicator_members(df, table, RULES)
    assert members.groupBy("indicator", "year", "n_sites").count().where("count <> n_sites").count() == 0
    included = sites_to_include(df, table, RULES)
    assert rows_of(included.groupBy("year", "n_sites").count()) == rows_of(
        fullest_indicator(table, RULES).selectExpr("year", "n_sites", "n_sites AS count")
    )


def test_site_detail(spark):
    df = site_years(
        spark,
        [
            {"mean": 1.0, "capture": 50.0},
            {"mean": 2.0, "measurement": "Daily"},
            {"site": "B", "mean": 3.0, "measurement": "Daily"},
        ],
    )
    register = spark.createDataFrame(
        [("A", "CA", 1.0, 2.0, "", "", "", "", ""), ("B", "CB", 3.0, 4.0, "", "", "", "", "")], STATIONS
    )
    register = register.selectExpr("*", "if(site = 'A', 'Hourly', 'Daily') AS measurement")
    included = spark.createDataFrame([(2018, 2, "A"), (2018, 2, "B"), (2018, 2, "C")], "year INT, n_sites BIGINT, site STRING")
    found = site_detail(included, df, register, RULES)
    # the hourly row of A gives way to nothing, although its capture is poor; C has no instrument at all
    assert rows_of(found, "site", "code", "mean", "measurement", "latitude") == [
        ("A", "CA", 1.0, "Hourly", 1.0),
        ("B", "CB", 3.0, "Daily", 3.0),
    ]
    assert found.columns == [
        *("site", "code", "latitude", "longitude", "year", "mean", "se"),
        *("capture", "measurement", "site_type", "zone"),
    ]


def test_detail_by_flags_equals_detail_by_lists(spark):
    for seed, by in ((34, ()), (35, ("zone",))):
        rules = replace(RULES, series=by)
        rows = [dict(r, zone="London" if int(r["site"][1:]) % 2 else "Surrey") for r in random_rows(seed)]
        df = site_years(spark, rows)
        table = indicator_table(indicator_profile(df, rules), rules)
        register = df.selectExpr("site", "zone", "measurement", "concat('C', site) AS code", "1D AS latitude", "2D AS longitude")
        register = register.distinct().where("site <> 'S2'")
        listed = site_detail(sites_to_include(df, table, rules), df, register, rules)
        assert rows_of(included_detail(df, table, register, rules)) == rows_of(listed)


def test_capture_statistics(spark):
    rows = [{"site": str(i), "capture": 90.0 if i else 50.0} for i in range(16)]
    rows += [{"year": 2015}, {"operational_all_year": None}, {"operational_all_year": False}]
    assert one(capture_statistics(site_years(spark, rows), RULES)) == {
        "year": 2018,
        "total_sites": 16,
        "sites_meeting_threshold": 15,
        "percent_meeting_threshold": 93.8,
    }
