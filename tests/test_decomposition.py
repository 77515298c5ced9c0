import pytest
from frames import one, rows_of, site_years
from test_indicators import random_rows

from breathline import Rules
from breathline.operators import (
    core_reduction,
    decomposed_reduction,
    edge_rows,
    increment_indicators,
    indicator_profile,
    indicator_table,
    relative_error,
    simplified_reduction,
    simplified_years,
    site_count_comparison,
    turnover_change,
)

RULES = Rules()
TABLE = "indicator STRING, year INT, mean DOUBLE, se_total DOUBLE, n_sites BIGINT"


@pytest.fixture(scope="module")
def table(spark):
    """Increments 2019 to 2023 over a base of 2016-2018, mean 10 falling by one a year, with a jump of 0.5 at 2020."""
    rows = [("PEI base", y, 10.0 - (y - 2016)) for y in (2016, 2017, 2018)]
    for n in range(2019, 2024):
        shift = 0.5 if n >= 2022 else 0.0
        rows += [(f"RI {n}", y, 10.0 - (y - 2016) + shift) for y in range(n - 3, n)]
        rows += [(f"PEI {n}", y, 10.0 - (y - 2016) + shift) for y in range(n - 2, n + 1)]
    return spark.createDataFrame([(i, y, m, 0.1, 5) for i, y, m in rows], TABLE)


def test_edge_rows(table):
    edges = edge_rows(table, RULES)
    in_order = edges.orderBy("year", "indicator").collect()
    assert sorted((r.indicator, r.year) for r in in_order) == sorted(
        [("PEI base", 2016), ("PEI base", 2017), ("PEI base", 2018)]
        + [(f"RI {n}", n - 3) for n in range(2019, 2024)]
        + [(f"PEI {n}", n) for n in range(2019, 2024)]
    )
    flags = {(r.indicator, r.year): r.shares_year for r in in_order}
    # unknown at either end, and set where a cohort's first year meets another's last
    assert flags["PEI base", 2016] is None
    assert flags["PEI 2023", 2023] is None
    assert {k for k, v in flags.items() if v} == {
        ("PEI 2019", 2019),
        ("RI 2022", 2019),
        ("PEI 2020", 2020),
        ("RI 2023", 2020),
    }


def test_turnover(table):
    assert rows_of(turnover_change(edge_rows(table, RULES), RULES)) == [(2019, 7.0, 7.5, 0.5), (2020, 6.0, 6.5, 0.5)]


def test_core_and_decomposed(table):
    edges = edge_rows(table, RULES)
    core = one(core_reduction(edges, RULES))
    assert core == {"total_of_base": 27.0, "total_after_base": 27.0, "total_at_end": 5.0 + 5.5 - 1 + 3.5}
    row = one(decomposed_reduction(edges, RULES))
    assert row["core_component"] == pytest.approx(100 * (core["total_at_end"] - 27.0) / 27.0)
    assert row["turnover_component"] == pytest.approx(100 * 1.0 / 27.0)
    assert row["decomposed_reduction"] == row["core_component"] - row["turnover_component"]


def test_one_sided_turnover_is_unknown(spark):
    rows = [("PEI base", 2016), ("PEI base", 2017), ("PEI base", 2018), ("RI 2022", 2019), ("RI 2021", 2019)]
    edges = edge_rows(spark.createDataFrame([(i, y, 1.0, 0.1, 5) for i, y in rows], TABLE), RULES)
    assert rows_of(turnover_change(edges, RULES), "year", "turnover") == [(2019, None)]
    assert one(decomposed_reduction(edges, RULES))["decomposed_reduction"] is None


@pytest.mark.parametrize("seed", [41, 42])
def test_decomposition_adds_up(spark, seed):
    """Summed unrounded increments are a third of what the edge rows say, with the opposite sign."""
    rows = [r for r in random_rows(seed, sites=30) if r["mean"] is not None and r.get("start_date") is None]
    profile = indicator_profile(site_years(spark, rows), RULES)
    edges = edge_rows(indicator_table(profile, RULES), RULES)
    increments = increment_indicators(profile, RULES)
    total = (
        increments.groupBy("increment_year")
        .pivot("indicator", ["RI", "PEI"])
        .mean("mean")
        .selectExpr("sum(RI - PEI)")
        .first()[0]
    )
    core = one(core_reduction(edges, RULES))
    turnover = sum(r.turnover for r in turnover_change(edges, RULES).collect())
    assert 3 * total == pytest.approx(core["total_after_base"] + turnover - core["total_at_end"])
    share = one(decomposed_reduction(edges, RULES))["decomposed_reduction"]
    assert share == pytest.approx(-100 * 3 * total / core["total_of_base"])


def test_both_indicators_of_an_increment_share_their_common_years(spark):
    profile = indicator_profile(site_years(spark, random_rows(43)), RULES)
    found = increment_indicators(profile, RULES)
    shared = found.where("year BETWEEN increment_year - 2 AND increment_year - 1")
    sides = [rows_of(shared.where(f"indicator = '{k}'").drop("indicator")) for k in ("RI", "PEI")]
    assert sides[0] == sides[1] != []


def test_simplified(spark):
    rows = [{"site": s, "year": y, "mean": float(m)} for s in "AB" for y, m in zip(range(2016, 2024), range(20, 12, -1))]
    rows.append({"site": "C", "year": 2024, "capture": 10.0})
    profile = indicator_profile(site_years(spark, rows), RULES)
    # the latest year has data but no site that counts
    assert rows_of(simplified_years(profile, RULES).where("in_target"), "year", "latest_year") == [
        (2022, 2024),
        (2023, 2024),
    ]
    row = one(simplified_reduction(profile, RULES))
    assert (row["year"], row["base_PEI"], row["target_PEI"]) == (2024, 19.0, 13.5)
    assert row["simplified_reduction"] == pytest.approx(100 * (13.5 - 19) / 19)


def test_relative_error_compares_like_with_like(spark):
    summary = spark.createDataFrame([(2023, 20.0), (2024, 24.98)], "year INT, perc_change DOUBLE")
    simplified = spark.createDataFrame([(-23.98,)], "simplified_reduction DOUBLE")
    assert one(relative_error(summary, simplified, RULES))["relative_error"] == pytest.approx(-4.0032, abs=1e-4)


def test_site_counts(spark):
    rows = [{"site": s, "year": y} for s in "AB" for y in range(2016, 2025)]
    rows += [{"site": "new", "year": y} for y in range(2023, 2025)]
    profile = indicator_profile(site_years(spark, rows), RULES)
    counts = site_count_comparison(profile, edge_rows(indicator_table(profile, RULES), RULES), RULES)
    assert rows_of(counts) == [(2022, 2, 2), (2023, 3, 2), (2024, 3, 2)]
