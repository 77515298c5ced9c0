import itertools
import random
from dataclasses import replace

import brute_force
import pytest
from frames import one, rows_of, site_years

from breathline import MissingColumnsError, Rules
from breathline.operators import (
    annual_indicator,
    base_indicator,
    base_summary,
    cohort_members,
    confidence_half_widths,
    cumulative_change,
    increment_deltas,
    increment_indicators,
    indicator_members,
    indicator_profile,
    indicator_table,
    population_indicator,
    prefer_hourly,
    reduction_summary,
    split_by_indicator,
    summary_absolute,
    summary_with_bounds,
)

RULES = Rules()


def four_years(captures=(90, 90, 90, 90), operational=(True,) * 4, years=range(2016, 2020), **more):
    return [
        {"year": y, "capture": float(c), "operational_all_year": o, **more}
        for y, c, o in zip(years, captures, operational)
    ]


# instrument preference -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("hourly", "daily", "kept"),
    [(90.0, 95.0, ["Hourly"]), (50.0, 95.0, ["Daily"]), (90.0, 50.0, ["Hourly"]), (50.0, 50.0, [])],
)
def test_instrument_that_counts(spark, hourly, daily, kept):
    rows = [{"capture": hourly, "mean": 1.0}, {"capture": daily, "mean": 2.0, "measurement": "Daily"}]
    found = population_indicator(site_years(spark, rows), RULES, 2018)
    assert rows_of(found, "mean", "n_sites") == [({"Hourly": 1.0, "Daily": 2.0}[m], 1) for m in kept]


def test_prefer_hourly_is_per_site_and_year(spark):
    df = site_years(
        spark,
        [{}, {"measurement": "Daily"}, {"measurement": "Daily", "year": 2019}, {"measurement": "Daily", "site": "B"}],
    )
    assert rows_of(prefer_hourly(df, RULES), "site", "year", "measurement") == [
        ("A", 2018, "Hourly"),
        ("A", 2019, "Daily"),
        ("B", 2018, "Daily"),
    ]


# cohorts ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("rows", "years"),
    [
        (four_years(), [2016, 2017, 2018, 2019]),
        (four_years(captures=(90, 90, 90), years=(2017, 2018, 2019)), [2017, 2018, 2019]),
        (four_years(captures=(90, 90, 50, 50)), []),
        (four_years(captures=(90, 90, 90, 50)), [2016, 2017, 2018, 2019]),
        (four_years(operational=(True, False, True, True)), []),
        (four_years(operational=(True, None, True, True)), []),
        (four_years(captures=(90, 90), years=(2018, 2019)), []),
    ],
)
def test_cohort(spark, rows, years):
    df = site_years(spark, rows)
    for members in (cohort_members(df, RULES, 2019), cohort_members(df, RULES).where("increment_year = 2019")):
        assert rows_of(members, "increment_year", "year") == [(2019, y) for y in years]


def test_instruments_qualify_separately(spark):
    rows = four_years(captures=(50, 50, 50, 50)) + four_years(measurement="Daily")
    members = cohort_members(site_years(spark, rows), RULES)
    assert {r.measurement for r in members.collect()} == {"Daily"}


def test_an_increment_year_needs_some_site(spark):
    """2016-2018 alone would satisfy the cohort of 2019, but nobody reports in 2019."""
    df = site_years(spark, four_years(captures=(90, 90, 90), years=(2016, 2017, 2018)))
    assert cohort_members(df, RULES).count() == 0
    assert increment_indicators(indicator_profile(df, RULES), RULES).count() == 0
    # another site does, even one that never counts
    late = site_years(spark, [{"site": "B", "year": 2019, "operational_all_year": None}])
    both = df.unionByName(late)
    assert {r.increment_year for r in cohort_members(both, RULES).collect()} == {2019}
    assert rows_of(increment_indicators(indicator_profile(both, RULES), RULES), "indicator", "year") == [
        ("PEI", 2017),
        ("PEI", 2018),
        ("RI", 2016),
        ("RI", 2017),
        ("RI", 2018),
    ]


def test_poor_year_of_a_member_does_not_count(spark):
    rows = four_years(captures=(90, 90, 90, 50)) + four_years(site="B", mean=20.0)
    table = increment_indicators(indicator_profile(site_years(spark, rows), RULES), RULES)
    assert rows_of(table.where("indicator = 'PEI'"), "year", "mean", "n_sites") == [
        (2017, 15.0, 2),
        (2018, 15.0, 2),
        (2019, 20.0, 1),
    ]


# annual means ----------------------------------------------------------------------------------------------------


def test_missing_columns_are_named(spark):
    df = site_years(spark, [{}]).drop("capture", "mean")
    for operator in (population_indicator, annual_indicator, indicator_profile):
        with pytest.raises(MissingColumnsError, match="mean, capture"):
            operator(df, RULES)


def test_default_end_is_the_latest_year_with_data(spark):
    rows = [{"year": y} for y in range(2015, 2020)] + [{"year": 2020, "capture": 10.0}]
    assert rows_of(population_indicator(site_years(spark, rows), RULES), "year") == [(2018,), (2019,)]


def test_one_site_has_no_error_and_counts_as_zero(spark):
    rows = [{"year": y, "mean": 10.004 + y - 2016} for y in (2016, 2017, 2018)]
    profile = indicator_profile(site_years(spark, rows), RULES)
    assert rows_of(base_indicator(profile, RULES), "se_total", "n_sites") == [(None, 1)] * 3
    assert one(base_summary(profile, RULES)) == {"year": 2018, "PEI": 11.0, "se_PEI": 0.0}


def test_error_divisor_stays_three(spark):
    rows = [{"site": s, "mean": m} for s, m in (("A", 1.0), ("B", 3.0))]
    row = one(base_summary(indicator_profile(site_years(spark, rows), RULES), RULES))
    assert row["se_PEI"] == pytest.approx(1.0 / 3)


def test_repeated_register_rows_count_twice_but_are_listed_once(spark):
    rows = [{"start_date": 2000}, {"start_date": 2001}]
    df = site_years(spark, rows)
    profile = indicator_profile(df, RULES)
    assert one(base_indicator(profile, RULES))["n_sites"] == 2
    assert indicator_members(df, indicator_table(profile, RULES), RULES).count() == 1


# change ----------------------------------------------------------------------------------------------------------

INCREMENTS = "increment_year INT, indicator STRING, year INT, mean DOUBLE, se_total DOUBLE, n_sites BIGINT"


def test_missing_indicator_leaves_the_rest_unknown(spark):
    rows = [
        (n, kind, n - 1, mean, 0.3, 5)
        for n, kind, mean in [
            (2019, "RI", 10.0),
            (2019, "PEI", 9.0),
            (2020, "PEI", 8.0),
            (2021, "RI", 8.0),
            (2021, "PEI", 7.5),
        ]
    ]
    deltas = increment_deltas(spark.createDataFrame(rows, INCREMENTS), RULES)
    df = cumulative_change(deltas, RULES)
    assert rows_of(df, "increment_year", "delta_PEI", "delta_PEI_cumulative") == [
        (2019, 1.0, 1.0),
        (2020, None, None),
        (2021, 0.5, None),
    ]
    assert [r[1] is None for r in rows_of(df, "increment_year", "se_delta_PEI_cumulative")] == [False, True, True]


PROFILE = "kind STRING, increment_year INT, year INT, mean DOUBLE, se_total DOUBLE, n_sites BIGINT"


@pytest.fixture(scope="module")
def summary(spark):
    rows = [("ALONE", None, y, 10.0, 0.3, 9) for y in (2016, 2017, 2018)]
    rows += [("RI", 2019, y, 10.0, 0.3, 9) for y in (2016, 2017, 2018)]
    rows += [("PEI", 2019, y, 8.766, 0.4, 9) for y in (2017, 2018, 2019)]
    return reduction_summary(spark.createDataFrame(rows, PROFILE), RULES)


def test_summary(summary):
    base, later = (r.asDict() for r in summary.orderBy("year").collect())
    se_base = (3 * 0.3**2) ** 0.5 / 3
    assert base == {
        "year": 2018,
        "PEI": 10.0,
        "se_PEI": pytest.approx(se_base),
        **dict.fromkeys(["delta_PEI", "se_delta_PEI", "delta_PEI_cumulative", "se_delta_PEI_cumulative"]),
        **dict.fromkeys(["perc_change", "se_perc_change"]),
    }
    se_delta = (3 * 0.3**2 / 9 + 3 * 0.4**2 / 9) ** 0.5
    assert later == {
        "year": 2019,
        "PEI": pytest.approx(8.77),
        "se_PEI": pytest.approx((se_base**2 + se_delta**2) ** 0.5),
        "delta_PEI": 1.23,
        "se_delta_PEI": pytest.approx(se_delta),
        "delta_PEI_cumulative": 1.23,
        "se_delta_PEI_cumulative": pytest.approx(se_delta),
        "perc_change": 12.3,
        "se_perc_change": pytest.approx(((10 * se_delta) ** 2 + (1.23 * se_base) ** 2) ** 0.5),
    }


def test_intervals(summary):
    row = confidence_half_widths(summary, RULES).where("year = 2019").first()
    assert row.ci_PEI == brute_force.half_up(1.96 * row.se_PEI, 2)
    assert row.ci_perc_change == brute_force.half_up(1.96 * row.se_perc_change, 2)
    bounds = summary_with_bounds(confidence_half_widths(summary, RULES), RULES).where("year = 2019").first()
    assert bounds.ci_PEI_lower == pytest.approx(row.PEI - row.ci_PEI)
    # whole percent, from the two-digit values
    assert bounds.perc_change == 12.0
    assert bounds.ci_perc_change_lower == brute_force.half_up(row.perc_change - row.ci_perc_change)
    assert bounds.ci_perc_change_upper == brute_force.half_up(row.perc_change + row.ci_perc_change)
    absolute = summary_absolute(confidence_half_widths(summary, RULES), RULES).where("year = 2019").first()
    assert (absolute.perc_change, absolute.ci_perc_change) == (12.3, row.ci_perc_change)


# everything against plain loops ----------------------------------------------------------------------------------


def random_rows(seed, sites=9, years=range(2013, 2024)):
    pick = random.Random(seed)
    rows = []
    for site, measurement in itertools.product((f"S{i}" for i in range(sites)), ("Hourly", "Daily")):
        if pick.random() < 0.3:
            continue
        for year in years:
            if pick.random() < 0.12:
                continue
            rows.append(
                {
                    "site": site,
                    "year": year,
                    "measurement": measurement,
                    "mean": None if pick.random() < 0.02 else round(pick.uniform(5, 15), 3),
                    "capture": float(pick.choice([20, 84, 85, 95, 99, 99, 99])),
                    "operational_all_year": pick.choice([True] * 14 + [False, None]),
                }
            )
            if pick.random() < 0.05:
                rows.append(dict(rows[-1], start_date=2001))
    return rows


def close(found, expected):
    assert set(found) == set(expected)
    for key, values in expected.items():
        for a, b in zip(found[key], values):
            assert a == (pytest.approx(b, abs=1e-9) if isinstance(b, float) else b), key


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_loops(spark, seed):
    rows = random_rows(seed)
    df = site_years(spark, rows)
    profile = indicator_profile(df, RULES)
    expected = brute_force.indicators(rows, 2018)
    table = indicator_table(profile, RULES)
    found = {(r.indicator, r.year): (r.mean, r.se_total, r.n_sites) for r in table.collect()}
    close(found, {k: v[:3] for k, v in expected.items()})

    sites = {}
    for r in indicator_members(df, table, RULES).collect():
        sites.setdefault((r.indicator, r.year), []).append(r.site)
    assert {k: sorted(v) for k, v in sites.items()} == {k: v[3] for k, v in expected.items()}

    summary = {
        r.year: (r.PEI, r.se_PEI, r.delta_PEI, r.delta_PEI_cumulative, r.perc_change)
        for r in reduction_summary(profile, RULES).collect()
    }
    close(summary, brute_force.summary(rows, 2018))


def test_profile_equals_the_stepwise_way(spark):
    df = site_years(spark, random_rows(11))
    quick = increment_indicators(indicator_profile(df, RULES), RULES)
    long = split_by_indicator(annual_indicator(cohort_members(df, RULES), RULES, by=("increment_year",)), RULES)
    columns = ("increment_year", "indicator", "year", "n_sites")
    assert rows_of(quick, *columns) == rows_of(long, *columns)


def test_series_are_independent(spark):
    rules = replace(RULES, series=("zone",))
    parts = {"North": random_rows(21), "South": random_rows(22), "East": random_rows(23, years=range(2019, 2022))}
    both = site_years(spark, [dict(r, zone=zone) for zone, rows in parts.items() for r in rows])
    joint = reduction_summary(indicator_profile(both, rules), rules)
    for zone, rows in parts.items():
        if zone == "East":
            continue
        alone = reduction_summary(indicator_profile(site_years(spark, rows), RULES), RULES)
        found = {r.year: tuple(r)[2:] for r in joint.where(f"zone = '{zone}'").collect()}
        close(found, {r.year: tuple(r)[1:] for r in alone.collect()})
    # without a base there is nothing to compare with
    assert {r.PEI for r in joint.where("zone = 'East'").collect()} <= {None}


def test_cohort_and_indicator_lengths_belong_together():
    with pytest.raises(ValueError, match="two successive indicators"):
        Rules(cohort_years=5)
