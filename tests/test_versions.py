import csv
import json
from dataclasses import replace

import pytest
from frames import rows_of
from pyspark.sql import functions as F

import run
from breathline.functions.files import names_in
from breathline.plans import assess
from breathline.sources import load_frame, select_readings
from breathline.sources.published import round_numbers
from breathline.sources.star_schema import SALES_RULES, sales_readings, sales_stations
from breathline.sources.versions import current_version, drop_versions, publish_version, published_versions

DATA = "/root/testdata/sf0.001"


def numbers(spark, folder):
    return [r.id for r in spark.read.parquet(folder).orderBy("id").collect()]


def test_the_last_published_set_is_current(spark, tmp_path):
    root = f"{tmp_path}/set"
    with pytest.raises(FileNotFoundError):
        current_version(spark, root)
    for n in (3, 5):
        folder = publish_version(spark, root, lambda f, n=n: spark.range(n).write.parquet(f))
        assert current_version(spark, root) == folder
        assert numbers(spark, current_version(spark, root)) == list(range(n))


def test_a_job_that_dies_leaves_the_former_set(spark, tmp_path):
    root = f"{tmp_path}/set"
    folder = publish_version(spark, root, lambda f: spark.range(3).write.parquet(f"{f}/a"))

    def half(target):
        spark.range(9).write.parquet(f"{target}/a")
        spark.range(9).select(F.expr("raise_error('died')").alias("x")).write.parquet(f"{target}/b")

    with pytest.raises(Exception, match="died"):
        publish_version(spark, root, half)
    assert current_version(spark, root) == folder
    assert numbers(spark, f"{current_version(spark, root)}/a") == [0, 1, 2]
    # the next attempt goes beyond what the failed one left
    third = publish_version(spark, root, lambda f: spark.range(4).write.parquet(f"{f}/a"))
    assert current_version(spark, root) == third and len(names_in(spark, f"{root}/versions")) == 3


def test_old_versions_and_leftovers_go(spark, tmp_path):
    root = f"{tmp_path}/set"
    assert drop_versions(spark, root) == []
    folders = []
    for n in range(4):
        folders.append(publish_version(spark, root, lambda f: spark.range(2).write.parquet(f)))
        if n == 1:
            with pytest.raises(ZeroDivisionError):
                publish_version(spark, root, lambda f: spark.range(1).write.parquet(f) or 1 / 0)
    assert len(drop_versions(spark, root, keep=2)) == 3
    assert [f"{root}/versions/{n}" for n in published_versions(spark, root)] == folders[2:]
    assert names_in(spark, f"{root}/versions") == published_versions(spark, root)
    with pytest.raises(ValueError, match="current version"):
        drop_versions(spark, root, keep=0)


def test_an_assessment_is_published_as_one(spark, tmp_path):
    root = f"{tmp_path}/assessment"
    stations = sales_stations(spark, DATA)
    planned = assess(select_readings(sales_readings(spark, DATA), SALES_RULES), stations, SALES_RULES)
    folder = planned.publish_version(root)
    assert rows_of(round_numbers(load_frame(spark, f"{folder}/data/summary_bounds"), 9)) == rows_of(round_numbers(planned.bounds, 9))
    # one of the last frames fails: the files of all others are written, and nobody sees them
    codes = planned.stations.withColumn("code", F.expr("if(site LIKE '%1', raise_error('no code'), code)"))
    broken = replace(planned, stations=codes)
    with pytest.raises(Exception, match="no code"):
        broken.publish_version(root)
    assert current_version(spark, root) == folder
    (left,) = {*names_in(spark, f"{root}/versions")} - {*published_versions(spark, root)}
    assert "sites_to_include" in names_in(spark, f"{root}/versions/{left}/tables/data_for_modelling")


def test_command_line_with_batches_versions_and_tables_of_rules(spark, tmp_path):
    readings = sales_readings(spark, DATA)
    early = F.col("date") < F.lit("1997-01-01").cast("timestamp_ntz")
    for name, part in (("old", early), ("new", ~early)):
        readings.where(part).write.parquet(f"{tmp_path}/{name}")
    sales_stations(spark, DATA).write.parquet(f"{tmp_path}/stations")
    spark.createDataFrame([("Supplier#000000001", 2100)], "site STRING, first_year INT").write.parquet(f"{tmp_path}/exceptions")
    rules = {"first_year": None, "readings_per_day": {"Hourly": 0.25, "Daily": 0.25}, "excluded_zones": "AFRICA"}
    rules |= {"base_window": [1995, 1997], "base_year": 1997, "statistics_from": 1995}
    (tmp_path / "rules.json").write_text(json.dumps(rules))
    common = ["--rules", f"{tmp_path}/rules.json"]
    for name in ("old", "new"):
        run.main(["add", "--readings", f"{tmp_path}/{name}", "--store", f"{tmp_path}/store", "--batch", name, *common])
    source = ["--store", f"{tmp_path}/store", "--stations", f"{tmp_path}/stations", "--versions", f"{tmp_path}/out"]
    run.main(["assess", *source, *common])
    folder = current_version(spark, f"{tmp_path}/out")
    found = spark.read.option("header", True).csv(f"{folder}/tables/summary_absolute").collect()
    assert sorted((r[0], r[3]) for r in found if r[3]) == [("1998", "0.06"), ("1999", "-0.22"), ("2000", "-0.35"), ("2001", "0.46")]
    run.main(["assess", *source, "--exceptions", f"{tmp_path}/exceptions", *common])
    later = current_version(spark, f"{tmp_path}/out")
    sites = load_frame(spark, f"{later}/data/site_years").select("site").distinct()
    assert later != folder and sites.where("site = 'Supplier#000000001'").count() == 0
    run.main(["analyse", "--versions", f"{tmp_path}/out", "--tables", f"{tmp_path}/analysis", *common])
    files = [*(tmp_path / "analysis" / "decomposed").glob("*.csv")]
    assert sum(len([*csv.reader(f.open())]) - 1 for f in files) == 1
    with pytest.raises(SystemExit):
        run.main(["assess", "--stations", "x", *common])
