"""URL block and allow rules by a sorted sweep over reversed-host keys, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialise
from ..functions.sql import text
from .text import LOWER, UPPER

BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Rule:
    """``block`` or ``allow`` for a host with all its subdomains, where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """A short list of rules as rows, written out in the plan; long lists are tables with these columns already."""
    if not rules:
        return spark.range(0).selectExpr("'' AS verdict", "'' AS host", "'' AS path")
    rows = ", ".join(f"({text(r.verdict)}, {text(r.host)}, {text(r.path)})" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(verdict, host, path)")


def host_and_path(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end.  Both are empty without ``://``."""
    given = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", given)
    rest = F.when(at > 0, F.substr(given, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


# Host labels from the top domain down: the hosts a host belongs to are then the prefixes of its labels.
_LABELS = "reverse(split(host, '[.]', -1))"


def _start_key(host: str, path: str) -> str:
    return f"encode(concat(array_join({host}, '.'), {path}), 'UTF-8')"


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = ALLOW) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (its host and path; null if none fits) and ``verdict`` of every page.

    ``rules`` has the columns ``verdict``, ``host`` and ``path``.  Of several rules that fit, the one with most characters
    wins, then the one with the longer host; of rules with the same host and path, block wins.  Rows with a null in a rule
    are no rules.  A page that no rule fits gets ``otherwise``.  Rows that repeat are each returned.

    A rule's key is its host, labels reversed, then its path.  The keys of all urls it fits by that host are the interval
    from that key to the key followed by byte FF, which no text holds.  A url has one key for each host it belongs to.
    Intervals of keys either nest or are apart, so a sweep over starts, ends and urls in key order needs a stack only: the
    running sum of starts less ends is its height, and its top is the latest start that reached this height.

    The sweep runs over range partitions, cut by sampled keys, so a host with a third of all pages spreads over many; each
    partition takes over the height and the open rules from those before it, which are a few rows per partition and height.
    """
    host, path = host_and_path()
    urls = (
        pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"))
        .groupBy("page_id", "host", "path")
        .agg(F.count("*").alias("copies"))
    )
    # a url without a host belongs to none
    hosts = f"if(host = '', array(), transform(sequence(1, size({_LABELS})), n -> slice({_LABELS}, 1, n)))"
    url_keys = urls.selectExpr("page_id", "host", "path", "copies", f"explode({hosts}) AS suffix").selectExpr(
        f"{_start_key('suffix', 'path')} AS key",
        "1 AS kind",
        "0L AS delta",
        "named_struct('page_id', page_id, 'host', host, 'path', path) AS page",
        "CAST(NULL AS struct<length: int, host_length: int, rule: string, verdict: string>) AS rule",
    )
    known = (
        rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.expr(f"if(bool_or(verdict = '{BLOCK}'), '{BLOCK}', '{ALLOW}')").alias("verdict"))
    )
    name = "concat(host, path)"
    bounds = known.selectExpr(
        f"{_start_key(_LABELS, 'path')} AS start",
        f"named_struct('length', length({name}), 'host_length', length(host), 'rule', {name}, 'verdict', verdict) AS rule",
    ).selectExpr(
        "inline(array("
        "named_struct('key', start, 'kind', 0, 'delta', 1L, 'rule', rule), "
        "named_struct('key', concat(start, X'FF'), 'kind', 2, 'delta', -1L, 'rule', NULL)))"
    )
    page = "page struct<page_id: {}, host: string, path: string>".format(dict(urls.dtypes)["page_id"])
    events = url_keys.unionByName(bounds.withColumn("page", F.lit(None).cast(page.removeprefix("page "))))
    # where a row lies is written down, since it decides what its partition takes over
    swept = materialise(
        events.repartitionByRange("key", "kind", F.xxhash64("page")).withColumn("part", F.spark_partition_id())
    )
    in_order = "ORDER BY key, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

    before = swept.groupBy("part").agg(F.sum("delta").alias("net")).selectExpr(
        "part", "sum(net) OVER (ORDER BY part) - net AS height_before"
    )
    heights = swept.join(before, "part").selectExpr(
        "part", "key", "kind", "page", "rule", f"height_before + sum(delta) OVER (PARTITION BY part {in_order}) AS height"
    )
    # the rule open at a height when a partition begins: the last start there, in any partition before
    open_before = (
        heights.where("height > 0")
        .groupBy("part", "height")
        .agg(F.expr("max_by(rule, if(kind = 0, key, NULL)) AS opened"))
        .selectExpr(
            "part",
            "height",
            "last(opened, true) OVER (PARTITION BY height ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
            " AS carried",
        )
        .where("carried IS NOT NULL")
    )
    tops = heights.selectExpr(
        "part", "kind", "page", "height", f"last(rule, true) OVER (PARTITION BY part, height {in_order}) AS own"
    ).where("kind = 1 AND height > 0")
    fits = tops.join(open_before, ["part", "height"], "left").selectExpr("page.*", "coalesce(own, carried) AS top")
    best = fits.groupBy("page_id", "host", "path").agg(F.max("top").alias("top"))
    same = [urls[c].eqNullSafe(best[c]) for c in ("page_id", "host", "path")]
    return urls.join(best, same[0] & same[1] & same[2], "left").select(
        urls["page_id"],
        urls["host"],
        urls["path"],
        F.col("top.rule").alias("rule"),
        F.coalesce("top.verdict", F.lit(otherwise)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
