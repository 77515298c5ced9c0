"""Command line, for ``spark-submit run.py ...`` or ``python run.py ...``.

    run.py assess  --readings DIR --stations DIR (--data DIR --tables DIR | --versions DIR) [--rules FILE]
                   [--exceptions DIR] [--renames DIR]
    run.py add     --readings DIR --store DIR --batch NAME [--annual DIR] [--rules FILE]
    run.py analyse (--data DIR | --versions DIR) --tables DIR [--rules FILE]

``--rules`` is a JSON object whose entries replace those of ``breathline.Rules``.  ``--versions`` publishes everything as
one unit, or reads what was published last.  ``--exceptions`` and ``--renames`` are Parquet tables in place of the rules'
entries.  ``add`` condenses new readings into a store of batches; ``assess --store DIR`` then needs no ``--readings``.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import SparkSession

from breathline import Rules
from breathline.plans import assess, assess_annual
from breathline.plans.analysis import analyse_saved
from breathline.session import configure
from breathline.sources import read_readings, read_stations
from breathline.sources.batches import add_readings, read_annual, refresh_annual
from breathline.sources.published import write_tables
from breathline.sources.versions import current_version


def load_rules(path: str | None) -> Rules:
    if path is None:
        return Rules()
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    return replace(Rules(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, required, optional in (
        ("assess", ("stations",), ("readings", "store", "data", "tables", "versions", "exceptions", "renames")),
        ("add", ("readings", "store", "batch"), ("annual",)),
        ("analyse", ("tables",), ("data", "versions")),
    ):
        job = jobs.add_parser(name)
        for option in required:
            job.add_argument(f"--{option}", required=True)
        for option in (*optional, "rules"):
            job.add_argument(f"--{option}")
        if name == "assess":
            job.add_argument("--stations-format", default="parquet")
    args = parser.parse_args(argv)
    if args.job == "assess" and (args.readings is None) == (args.store is None):
        parser.error("assess needs either --readings or --store")
    if args.job == "assess" and args.versions is None and None in (args.data, args.tables):
        parser.error("assess needs --versions, or --data and --tables")
    if args.job == "analyse" and (args.data is None) == (args.versions is None):
        parser.error("analyse needs either --data or --versions")
    rules = load_rules(args.rules)
    spark = configure(SparkSession.builder.appName(f"breathline-{args.job}").getOrCreate())
    if args.job == "add":
        add_readings(read_readings(spark, args.readings, rules), args.store, args.batch, rules)
        if args.annual:
            refresh_annual(spark, args.store, args.annual, args.batch, rules)
    elif args.job == "assess":
        stations = read_stations(spark, args.stations, args.stations_format)
        tables = [path and spark.read.parquet(path) for path in (args.exceptions, args.renames)]
        if args.store:
            done = assess_annual(read_annual(spark, args.store, rules), stations, rules, *tables)
        else:
            done = assess(read_readings(spark, args.readings, rules), stations, rules, *tables)
        if args.versions:
            done.publish_version(args.versions)
        else:
            done.publish(args.data, args.tables)
    else:
        data = args.data or f"{current_version(spark, args.versions)}/data"
        analysis = analyse_saved(spark, data, rules)
        write_tables(analysis.sorted_tables(rules), args.tables, fmt="csv")


if __name__ == "__main__":
    main()
