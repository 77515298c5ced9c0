import random
from dataclasses import replace

import pytest
from frames import plan_of, rows_of
from pyspark.sql import functions as F

from breathline import Rules
from breathline.operators import annual_site_stats, merge_moments, moments, stats_of_moments
from breathline.sources.batches import (
    add_readings,
    batches_in,
    compact,
    read_annual,
    read_moments,
    refresh_annual,
    years_of,
)

RULES = Rules()
SCHEMA = "site STRING, year INT, measurement STRING, value DOUBLE"


def random_readings(spark, seed=1, n=3000, scale=10.0):
    pick = random.Random(seed)
    rows = [
        (
            f"S{pick.randrange(5)}",
            pick.randrange(2015, 2020),
            pick.choice(["Hourly", "Daily"]),
            None if pick.random() < 0.1 else round(pick.gauss(scale, 3), pick.randrange(0, 6)),
        )
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def exactly(df):
    """Rows with doubles to the last bit."""
    names = sorted(df.columns)
    return sorted(tuple(v.hex() if isinstance(v, float) else v for v in (r[c] for c in names)) for r in df.collect())


def test_any_split_in_any_order_gives_the_same_bits(spark):
    df = random_readings(spark)
    whole = exactly(stats_of_moments(moments(df, RULES), RULES))
    for seed in range(3):
        parts = df.randomSplit([1.0, 5.0, 2.0, 1.0], seed)
        states = [moments(p.repartition(1 + 3 * seed), RULES) for p in reversed(parts)]
        merged = merge_moments(merge_moments(*states[:2], rules=RULES), *states[2:], rules=RULES)
        assert exactly(stats_of_moments(merged, RULES)) == whole


@pytest.mark.parametrize("scale", [0.0, 10.0, 1e5, 1e8])
def test_moments_agree_with_the_plain_aggregate(spark, scale):
    df = random_readings(spark, 2, scale=scale)
    rules = replace(RULES, measurement_error=0.1)
    wanted = {(r.site, r.year, r.measurement): r for r in annual_site_stats(df, rules).collect()}
    found = stats_of_moments(moments(df, rules), rules).collect()
    assert len(found) == len(wanted)
    for r in found:
        other = wanted[r.site, r.year, r.measurement]
        assert r["mean"] == pytest.approx(other["mean"], rel=1e-12, abs=1e-12)
        assert r.se_sampling_within_site == pytest.approx(other.se_sampling_within_site, rel=1e-9)
        assert r.capture == pytest.approx(other.capture)


def test_small_deviations_beside_a_large_mean_are_kept(spark):
    df = spark.range(1000).selectExpr("'A' AS site", "2019 AS year", "'Daily' AS measurement", "1e8 + (id % 2) / 1000 AS value")
    row = stats_of_moments(moments(df, RULES), RULES).first()
    assert row.se_sampling_within_site == pytest.approx(0.0005 * (1000 / 999) ** 0.5 / 1000**0.5, rel=1e-9)


def test_groups_without_valid_readings_and_with_one(spark):
    df = spark.createDataFrame([("A", 2019, "Daily", None), ("B", 2019, "Daily", 4.0)], SCHEMA)
    found = stats_of_moments(moments(df, RULES), RULES)
    assert rows_of(found, "site", "mean", "se_sampling_within_site") == [("A", None, None), ("B", 4.0, None)]
    assert found.where("site = 'A'").first().capture == 0.0
    assert exactly(found) == exactly(stats_of_moments(merge_moments(moments(df, RULES), moments(df.limit(0), RULES), rules=RULES), RULES))


def test_series_keys_stay_apart(spark):
    rules = replace(RULES, series=("network",))
    df = random_readings(spark, 3, 200).withColumn("network", F.when(F.col("site") < "S2", "n1").otherwise("n2"))
    found = stats_of_moments(merge_moments(moments(df, rules), rules=rules), rules)
    assert found.columns[0] == "network" and {r.network for r in found.collect()} == {"n1", "n2"}


def test_store_equals_a_full_run(spark, tmp_path):
    df, store, table = random_readings(spark, 4), f"{tmp_path}/store", f"{tmp_path}/annual"
    first, second, third = df.where("year < 2017"), df.where("year >= 2018"), df.where("year = 2017")
    late = second.where("site = 'S1' AND year = 2019")
    for batch, part in (("b1", first), ("b2", second.exceptAll(late)), ("b3", third), ("b4", late)):
        add_readings(part, store, batch, RULES)
        years = refresh_annual(spark, store, table, batch, RULES)
        assert years == sorted({r.year for r in part.select("year").distinct().collect()})
    whole = exactly(stats_of_moments(moments(df, RULES), RULES))
    assert exactly(read_annual(spark, store, RULES)) == whole
    assert exactly(spark.read.parquet(table)) == whole
    # a batch sent again counts once
    add_readings(first, store, "b1", RULES)
    assert exactly(read_annual(spark, store, RULES)) == whole
    compact(spark, store, f"{tmp_path}/compacted", RULES)
    assert batches_in(spark, f"{tmp_path}/compacted") == ["all"]
    assert exactly(read_annual(spark, f"{tmp_path}/compacted", RULES)) == whole
    with pytest.raises(ValueError, match="another store"):
        compact(spark, store, f"{store}/", RULES)


def test_only_the_years_of_a_batch_are_read_and_replaced(spark, tmp_path):
    df, store, table = random_readings(spark, 5), f"{tmp_path}/store", f"{tmp_path}/annual"
    add_readings(df, store, "b1", RULES)
    refresh_annual(spark, store, table, "b1", RULES)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "annual").rglob("*.parquet")}
    add_readings(df.where("year = 2018").limit(5), store, "b2", RULES)
    assert years_of(spark, store, "b2") == [2018]
    assert refresh_annual(spark, store, table, "b2", RULES) == [2018]
    again = {p: p.stat().st_mtime_ns for p in (tmp_path / "annual").rglob("*.parquet")}
    assert {p for p in files if again.get(p) == files[p]} == {p for p in files if "year=2018" not in str(p)}
    plan = plan_of(read_moments(spark, store, RULES, [2018]))
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [(year" in plan


def test_an_incomplete_batch_does_not_count(spark, tmp_path):
    df, store = random_readings(spark, 6, 300), f"{tmp_path}/store"
    add_readings(df, store, "good", RULES)
    whole = exactly(read_annual(spark, store, RULES))
    broken = df.withColumn("value", F.expr("if(site = 'S3', raise_error('lost'), value)"))
    with pytest.raises(Exception, match="lost"):
        add_readings(broken, store, "bad", RULES)
    assert batches_in(spark, store) == ["good"]
    assert exactly(read_annual(spark, store, RULES)) == whole
    with pytest.raises(ValueError, match="no complete batch"):
        read_annual(spark, f"{tmp_path}/nothing", RULES)
    with pytest.raises(ValueError, match="batch is named"):
        add_readings(df, store, "../b", RULES)
