from dataclasses import replace

import pytest
from frames import one, plan_of, rows_of, site_years

from breathline import Rules
from breathline.operators import clean_stations, eligible_site_years, operational_site_years
from breathline.schemas import STATIONS

RULES = Rules()


def stations(spark, *rows):
    """Rows are (site, variable, start, end)."""
    return spark.createDataFrame(
        [(s, "C", 1.0, 2.0, "Urban Background", "London", v, a, b) for s, v, a, b in rows], STATIONS
    )


def test_clean(spark):
    df = clean_stations(
        stations(
            spark,
            ("A", "PM2.5", "2008-02-03", "ongoing"),
            ("A", "PM2.5", "2008-02-03", "ongoing"),
            ("A", "GR2.5", "2010-12-31", "2015-01-01"),
            ("A", "NO2", "2008-02-03", "ongoing"),
            ("B", "PM2.5", "2008-01-01 00:00:00", "rubbish"),
        ),
        RULES,
    )
    assert rows_of(df, "site", "measurement", "start_date", "end_date") == [
        ("A", "Daily", 2010, 2015),
        ("A", "Hourly", 2008, None),
        ("B", "Hourly", 2008, None),
    ]


def test_renamed_site(spark):
    df = clean_stations(stations(spark, ("Dewsbury Ashworth Grove", "PM2.5", "2008-01-01", "ongoing")), RULES)
    assert rows_of(df, "site") == [("Dewsbury Ashworth Grange",)]


@pytest.mark.parametrize(
    ("start", "end", "expected"),
    [
        ("2017-06-01", "ongoing", True),
        ("2018-01-01", "ongoing", False),
        ("2000-01-01", "2018-12-31", False),
        ("2000-01-01", "2019-01-01", True),
        (None, "ongoing", None),
        (None, "2018-01-01", False),
    ],
)
def test_operational_all_year(spark, start, end, expected):
    register = clean_stations(stations(spark, ("A", "PM2.5", start, end)), RULES)
    annual = site_years(spark, [{"year": 2018}]).select(
        "site", "year", "mean", "se_sampling_within_site", "capture", "measurement"
    )
    assert one(operational_site_years(annual, register, RULES))["operational_all_year"] is expected


def test_no_register_row(spark):
    register = clean_stations(stations(spark, ("B", "PM2.5", "2000-01-01", "ongoing")), RULES)
    annual = site_years(spark, [{}]).select("site", "year", "mean", "capture", "measurement")
    joined = operational_site_years(annual, register, RULES)
    row = one(joined)
    assert (row["operational_all_year"], row["zone"]) == (None, None)
    assert eligible_site_years(joined, RULES).count() == 0


def test_two_register_rows_repeat_the_site_year(spark):
    register = clean_stations(
        stations(spark, ("A", "PM2.5", "2000-01-01", "ongoing"), ("A", "PM2.5", "2001-01-01", "ongoing")), RULES
    )
    annual = site_years(spark, [{}]).select("site", "year", "mean", "capture", "measurement")
    assert operational_site_years(annual, register, RULES).count() == 2


@pytest.mark.parametrize(
    ("change", "kept"),
    [
        ({}, True),
        ({"capture": 0.4}, False),
        ({"capture": 0.5}, True),
        ({"capture": None}, False),
        ({"zone": None}, False),
        ({"zone": "Central Scotland"}, False),
        ({"zone": "Highland"}, False),
        ({"zone": "North Wales"}, False),
        ({"zone": "Northern Ireland"}, False),
        ({"site_type": "Urban Traffic"}, False),
        ({"site_type": "Suburban Background"}, True),
        ({"site_type": None}, False),
        ({"site": "Warrington", "year": 2021}, False),
        ({"site": "Warrington", "year": 2022}, True),
        ({"site": "Middlesbrough", "year": 2021}, False),
        ({"site": "Middlesbrough", "year": 2022}, True),
    ],
)
def test_eligible(spark, change, kept):
    assert eligible_site_years(site_years(spark, [change]), RULES).count() == int(kept)


def test_capture_is_rounded_before_it_is_judged(spark):
    df = eligible_site_years(site_years(spark, [{"capture": 84.5}, {"capture": 84.49}]), RULES)
    assert rows_of(df, "capture") == [(84.0,), (85.0,)]


def test_series_from_both_sides(spark):
    """A key of both frames takes part in the join; a key of the register alone is brought along."""
    rules = replace(RULES, series=("network", "zone"))
    register = clean_stations(
        stations(spark, ("A", "PM2.5", "2000-01-01", "ongoing")).selectExpr("*", "'n1' AS network"), rules
    )
    annual = site_years(spark, [{}]).select("site", "year", "mean", "capture", "measurement")
    both = annual.selectExpr("'n1' AS network", "*").unionByName(annual.selectExpr("'n2' AS network", "*"))
    df = operational_site_years(both, register, rules)
    assert rows_of(df, "network", "zone") == [("n1", "London"), ("n2", None)]


def test_rules_as_tables_keep_the_plan_small(spark):
    def plans(n):
        exceptions = spark.range(n).selectExpr("concat('S', id) AS site", "2022 AS first_year")
        renames = spark.range(n).selectExpr("concat('S', id) AS site", "concat('T', id) AS current")
        register = clean_stations(stations(spark, ("A", "PM2.5", "2000-01-01", "ongoing")), RULES, renames)
        eligible = eligible_site_years(site_years(spark, [{}]), RULES, exceptions)
        return [len(plan_of(df).splitlines()) for df in (register, eligible)]

    assert plans(2) == plans(100_000)


def test_mappings_and_tables_of_rules_agree(spark):
    many = replace(
        RULES,
        site_exceptions={f"S{i}": 2010 + i % 12 for i in range(500)},
        renamed_sites={f"S{i}": f"S{i + 1}" for i in range(0, 500, 2)},
    )
    df = site_years(spark, [{"site": f"S{i % 700}", "year": 2010 + i % 13} for i in range(3000)])
    kept = rows_of(eligible_site_years(df, many), "site", "year")
    assert kept == sorted(
        (s, y) for s, y in rows_of(df, "site", "year") if not (int(s[1:]) < 500 and y < 2010 + int(s[1:]) % 12)
    )
    exceptions = spark.createDataFrame([(s, y) for s, y in many.site_exceptions.items()], "site STRING, first_year INT")
    # an earlier bound beside the real one, a bound of no site, and a null bound change nothing
    more = spark.createDataFrame([("S1", 1900), (None, 2100), ("S2", None)], "site STRING, first_year INT")
    assert rows_of(eligible_site_years(df, RULES, exceptions.unionByName(more)), "site", "year") == kept
    register = stations(spark, *[(f"S{i}", "PM2.5", "2000-01-01", "ongoing") for i in range(6)])
    wanted = [("S1",), ("S1",), ("S3",), ("S3",), ("S5",), ("S5",)]
    assert rows_of(clean_stations(register, many), "site") == wanted
    renames = spark.createDataFrame([*many.renamed_sites.items(), ("S0", "A first"), (None, "X")], "site STRING, current STRING")
    assert rows_of(clean_stations(register, RULES, renames), "site") == wanted


def test_a_site_without_a_name_meets_no_exception(spark):
    df = site_years(spark, [{"site": None, "year": 2000}, {"site": "Warrington", "year": 2000}])
    assert rows_of(eligible_site_years(df, RULES), "site") == [(None,)]
