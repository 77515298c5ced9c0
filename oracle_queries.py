"""The registered queries in SQL, step by step, straight from the definition.

Written for another engine and in another way than the Spark plans (increment years are joined by range and cohorts are
filtered one by one), so agreement means something.
"""

from __future__ import annotations

import re

# The published headers, for a base year of 1997.
BOUNDS_HEADERS = {
    "year": "Year",
    "PEI": "PEI (µg/m³)",
    "ci_PEI_lower": "Lower bound - 95% confidence interval for PEI (µg/m³)",
    "ci_PEI_upper": "Upper bound - 95% confidence interval for PEI (µg/m³)",
    "delta_PEI": "Year-on-year change in PEI (µg/m³)",
    "ci_delta_PEI_lower": "Lower bound - 95% confidence interval for year-on-year change (µg/m³)",
    "ci_delta_PEI_upper": "Upper bound - 95% confidence interval for year-on-year change (µg/m³)",
    "delta_PEI_cumulative": "Total change in PEI since 1997 (µg/m³)",
    "ci_delta_PEI_cumulative_lower": "Lower bound - 95% confidence interval for total change (µg/m³)",
    "ci_delta_PEI_cumulative_upper": "Upper bound - 95% confidence interval for total change (µg/m³)",
    "perc_change": "Total change in PEI since 1997 (%)",
    "ci_perc_change_lower": "Lower bound - 95% confidence interval for percent change (%)",
    "ci_perc_change_upper": "Upper bound - 95% confidence interval for percent change (%)",
}
ABSOLUTE_HEADERS = {
    "year": "Year",
    "PEI": "PEI (µg/m³)",
    "ci_PEI": "+/- 95% confidence interval for PEI (µg/m³)",
    "delta_PEI": "Year-on-year change in PEI (µg/m³)",
    "ci_delta_PEI": "+/- 95% confidence interval for year-on-year change (µg/m³)",
    "delta_PEI_cumulative": "Total change in PEI since 1997 (µg/m³)",
    "ci_delta_PEI_cumulative": "+/- 95% confidence interval for total change (µg/m³)",
    "perc_change": "Total change in PEI since 1997 (% unrounded)",
    "ci_perc_change": "+/- 95% confidence interval for percent change (% unrounded)",
}
THRESHOLD = 85


def half_up(x: str, digits: int = 0) -> str:
    scale = 10**digits
    return f"(sign({x}) * floor(abs({x}) * {scale}.0 + 0.5 + 1.4901161193847656e-8) / {scale}.0)"


def out(x: str, name: str | None = None) -> str:
    """Comparable number: nine digits."""
    return f'round({x}, 9) + 0.0 AS "{name or x}"'


BASE = (1995, 1997)


def steps(
    k: str = "", exceptions: dict[str, int] | None = None, base: tuple[int, int] = BASE, within: bool = False
) -> dict[str, str]:
    """Named steps; ``k`` is an extra series key with a trailing comma, such as ``"zone, "``.  ``base`` are the first and last
    year of the base window; ``within`` adds the mean error within sites to that between them."""
    between = "stddev_samp(mean) / sqrt(count(*))"
    error = between
    if within:
        inside = "sqrt(coalesce(sum(se_sampling_within_site * se_sampling_within_site), 0)) / count(*)"
        error = f"sqrt(({between}) * ({between}) + ({inside}) * ({inside}))"
    kn = k.strip().rstrip(",")  # the bare key
    over = f"PARTITION BY {kn} " if kn else ""
    on_k = f"AND a.{kn} = b.{kn}" if kn else ""
    except_sql = "".join(f" AND NOT (site = '{s}' AND year < {y})" for s, y in (exceptions or {}).items())
    s: dict[str, str] = {}
    s["readings"] = """
        SELECT s_name AS site, CAST(year(l_shipdate) AS INTEGER) AS year, l_shipdate AS date,
               CASE WHEN l_discount <> 0 THEN l_quantity END AS value, 'Hourly' AS measurement, 'None' AS averaging,
               'PM2.5' AS pollutant, l_linenumber
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 4 IN (0, 1, 2)
        UNION ALL
        SELECT s_name, CAST(year(l_shipdate) AS INTEGER), l_shipdate,
               CASE WHEN l_tax <> 0 THEN l_quantity * 1.1 END, 'Daily', 'None', 'PM2.5', l_linenumber
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 4 IN (0, 3)"""
    # whole numbers, as the engine cuts them off, typed in as text, with faults
    s["typed"] = """
        SELECT site, CASE WHEN value % 7 = 1 THEN 'y' || year ELSE year::VARCHAR END AS year,
               CASE WHEN value % 10 = 3 THEN trunc(value)::INT || ' approx' ELSE trunc(value)::INT::VARCHAR END AS value,
               CASE WHEN value = 50 THEN NULL ELSE pollutant END AS pollutant FROM readings"""
    s["checked"] = """
        SELECT site, TRY_CAST(year AS INT) AS year, TRY_CAST(value AS DOUBLE) AS value,
               concat_ws('; ', CASE WHEN TRY_CAST(year AS INT) IS NULL THEN 'year: ' || year END,
                         CASE WHEN pollutant IS NULL THEN 'pollutant: missing' END,
                         CASE WHEN value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL THEN 'value: ' || value END) AS faults
        FROM typed"""
    s["annual"] = """
        SELECT site, year, measurement, avg(value) AS mean,
               stddev_samp(value) / nullif(sqrt(count(value)), 0) AS se_sampling_within_site,
               count(value) / (CASE WHEN year % 4 = 0 THEN 366 ELSE 365 END * 0.25) * 100 AS capture
        FROM readings GROUP BY site, year, measurement"""
    s["instruments"] = """
        SELECT s_suppkey, 'PM2.5' AS variable FROM supplier WHERE s_suppkey % 4 IN (0, 1, 2)
        UNION ALL SELECT s_suppkey, 'GR2.5' FROM supplier WHERE s_suppkey % 4 IN (0, 3)"""
    s["register"] = """
        SELECT s_name AS site, 'S' || s_suppkey AS code, 50 + (s_suppkey % 100) / 20 AS latitude,
               (s_suppkey % 60) / 10 - 4 AS longitude,
               CASE s_suppkey % 10 WHEN 9 THEN 'Urban Traffic' WHEN 8 THEN 'Suburban Background'
                    ELSE 'Urban Background' END AS site_type,
               r_name AS zone, variable,
               CASE WHEN s_suppkey % 7 = 5 THEN '1996-03-01' ELSE '1990-01-01' END AS start_text,
               CASE WHEN s_suppkey % 11 = 10 THEN '2000-06-30' ELSE 'ongoing' END AS end_text
        FROM supplier JOIN instruments USING (s_suppkey) JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey"""
    s["stations"] = """
        SELECT DISTINCT site, code, latitude, longitude, site_type, zone,
               CASE variable WHEN 'PM2.5' THEN 'Hourly' ELSE 'Daily' END AS measurement,
               CAST(year(CAST(start_text AS DATE)) AS INTEGER) AS start_date,
               CAST(year(CAST(nullif(end_text, 'ongoing') AS DATE)) AS INTEGER) AS end_date
        FROM register WHERE variable IN ('PM2.5', 'GR2.5')"""
    s["operational"] = """
        SELECT a.*, site_type, zone, start_date, end_date,
               start_date < year AND coalesce(end_date, 999999) > year AS operational_all_year
        FROM annual a LEFT JOIN stations USING (site, measurement)"""
    s["eligible"] = f"""
        SELECT * FROM (SELECT * REPLACE ({half_up("capture")} AS capture) FROM operational)
        WHERE capture > 0 AND NOT regexp_matches(zone, 'AFRICA')
              AND site_type IN ('Suburban Background', 'Urban Background'){except_sql}"""
    s["usable"] = f"""
        SELECT * FROM eligible WHERE operational_all_year AND capture >= {THRESHOLD}
        QUALIFY NOT (measurement = 'Daily' AND bool_or(measurement = 'Hourly') OVER (PARTITION BY {k}year, site))"""
    s["yearly"] = f"""
        SELECT {k}year, avg(mean) AS mean, {error} AS se_total, count(*) AS n_sites,
               string_agg(DISTINCT site, '; ' ORDER BY site) AS sites
        FROM usable GROUP BY {k}year"""
    s["base_rows"] = f"SELECT * FROM yearly WHERE year BETWEEN {base[0]} AND {base[1]}"
    # every series has a base row, also without data in the base window
    every = f"(SELECT DISTINCT {kn} FROM eligible) LEFT JOIN base_rows USING ({kn}) GROUP BY {kn}" if kn else "base_rows"
    s["base"] = f"""
        SELECT {k}{base[1]} AS year, {half_up("avg(mean)", 2)} AS PEI,
               sqrt(coalesce(sum(se_total * se_total), 0)) / 3 AS se_PEI FROM {every}"""
    s["increment_years"] = f"SELECT DISTINCT {k}year AS n FROM eligible WHERE year > {base[1]}"
    s["cohorts"] = f"""
        SELECT b.n, a.* FROM eligible a JOIN increment_years b ON a.year BETWEEN b.n - 3 AND b.n {on_k}
        QUALIFY min(CASE WHEN operational_all_year THEN 1 ELSE 0 END) OVER (PARTITION BY {"a." + k if k else ""}b.n, site, measurement) = 1
            AND sum(CASE WHEN capture >= {THRESHOLD} THEN 1 ELSE 0 END)
                OVER (PARTITION BY {"a." + k if k else ""}b.n, site, measurement) >= 3"""
    s["cohort_usable"] = f"""
        SELECT * FROM cohorts WHERE operational_all_year AND capture >= {THRESHOLD}
        QUALIFY NOT (measurement = 'Daily' AND bool_or(measurement = 'Hourly') OVER (PARTITION BY {k}n, year, site))"""
    s["cohort_yearly"] = f"""
        SELECT {k}n, year, avg(mean) AS mean, {error} AS se_total, count(*) AS n_sites,
               string_agg(DISTINCT site, '; ' ORDER BY site) AS sites
        FROM cohort_usable GROUP BY {k}n, year"""
    s["increments"] = """
        SELECT 'RI' AS indicator, * FROM cohort_yearly WHERE year BETWEEN n - 3 AND n - 1
        UNION ALL SELECT 'PEI', * FROM cohort_yearly WHERE year BETWEEN n - 2 AND n"""
    s["means"] = f"""
        SELECT {k}n, indicator, avg(mean) AS mean, sqrt(coalesce(sum(se_total * se_total), 0)) / 3 AS se
        FROM increments GROUP BY {k}n, indicator"""
    s["deltas"] = f"""
        SELECT *, {half_up("(mean_RI - mean_PEI)", 2)} AS delta_PEI,
               sqrt(se_PEI * se_PEI + se_RI * se_RI) AS se_delta_PEI
        FROM (SELECT {k}n, max(mean) FILTER (indicator = 'RI') AS mean_RI, max(mean) FILTER (indicator = 'PEI') AS mean_PEI,
                     max(se) FILTER (indicator = 'RI') AS se_RI, max(se) FILTER (indicator = 'PEI') AS se_PEI
              FROM means GROUP BY {k}n)"""
    s["cumulative"] = f"""
        SELECT *, CASE WHEN count(*) FILTER (delta_PEI IS NULL) OVER w = 0
                       THEN sum(delta_PEI) OVER w END AS delta_PEI_cumulative,
               CASE WHEN count(*) FILTER (se_delta_PEI IS NULL) OVER w = 0
                    THEN sqrt(sum(se_delta_PEI * se_delta_PEI) OVER w) END AS se_delta_PEI_cumulative
        FROM deltas WINDOW w AS ({over}ORDER BY n ROWS UNBOUNDED PRECEDING)"""
    s["stacked"] = f"""
        SELECT {k}year, PEI, se_PEI, NULL AS delta_PEI, NULL AS se_delta_PEI, NULL AS delta_PEI_cumulative,
               NULL AS se_delta_PEI_cumulative FROM base
        UNION ALL SELECT {k}n, NULL, NULL, delta_PEI, se_delta_PEI, delta_PEI_cumulative, se_delta_PEI_cumulative
        FROM cumulative"""
    s["with_base"] = f"""
        SELECT *, max(PEI) FILTER (year = {base[1]}) OVER ({over.strip()}) AS base_PEI,
               max(se_PEI) FILTER (year = {base[1]}) OVER ({over.strip()}) AS base_se_PEI FROM stacked"""
    s["summary"] = f"""
        SELECT {k}year, CASE WHEN year > {base[1]} THEN base_PEI - delta_PEI_cumulative ELSE PEI END AS PEI,
               CASE WHEN year > {base[1]} THEN sqrt(base_se_PEI * base_se_PEI + se_delta_PEI_cumulative * se_delta_PEI_cumulative)
                    ELSE se_PEI END AS se_PEI,
               delta_PEI, se_delta_PEI, delta_PEI_cumulative, se_delta_PEI_cumulative,
               {half_up("(100 * delta_PEI_cumulative / base_PEI)", 2)} AS perc_change,
               sqrt((100 / base_PEI) * (100 / base_PEI) * se_delta_PEI_cumulative * se_delta_PEI_cumulative
                    + (100 * delta_PEI_cumulative / (base_PEI * base_PEI)) * (100 * delta_PEI_cumulative / (base_PEI * base_PEI))
                      * base_se_PEI * base_se_PEI) AS se_perc_change
        FROM with_base"""
    s["intervals"] = "SELECT *, " + ", ".join(f"{half_up(f'(1.96 * se_{m})', 2)} AS ci_{m}" for m in MEASURES) + " FROM summary"
    bounds = [f"{m}, {m} - ci_{m} AS ci_{m}_lower, {m} + ci_{m} AS ci_{m}_upper" for m in MEASURES[:3]]
    s["bounds"] = f"""
        SELECT {k}year, {", ".join(bounds)}, {half_up("perc_change")} AS perc_change,
               {half_up("(perc_change - ci_perc_change)")} AS ci_perc_change_lower,
               {half_up("(perc_change + ci_perc_change)")} AS ci_perc_change_upper FROM intervals"""
    s["indicators"] = f"""
        SELECT {k}'PEI base' AS indicator, 0 AS block, 0 AS n, 0 AS part_order, year, mean, se_total, n_sites, sites FROM base_rows
        UNION ALL SELECT {k}indicator || ' ' || n, 1, n, CASE indicator WHEN 'RI' THEN 0 ELSE 1 END, year, mean, se_total,
               n_sites, sites FROM increments"""
    s["fullest"] = f"""
        SELECT {k}year, n_sites, sites FROM indicators
        QUALIFY row_number() OVER (PARTITION BY {k}year ORDER BY n_sites DESC, block, n, part_order) = 1"""
    s["included"] = f"SELECT {k}year, unnest(string_split(sites, '; ')) AS site FROM fullest"
    s["edges"] = f"""
        SELECT *, lag(year) OVER w AS edge_before, lead(year) OVER w AS edge_after,
               year = lag(year) OVER w OR year = lead(year) OVER w AS shares_year
        FROM (SELECT * FROM indicators
              QUALIFY indicator = 'PEI base'
                 OR (indicator LIKE 'RI%' AND row_number() OVER (PARTITION BY {k}indicator ORDER BY year) = 1)
                 OR (indicator LIKE 'PEI%' AND row_number() OVER (PARTITION BY {k}indicator ORDER BY year DESC) = 1))
        WINDOW w AS ({over}ORDER BY block, year, n, part_order)"""
    group = f"GROUP BY {kn}" if kn else ""
    s["turnover"] = f"""
        SELECT *, RI - PEI AS turnover FROM (
            SELECT {k}year, max(mean) FILTER (indicator LIKE 'PEI%') AS PEI, max(mean) FILTER (indicator LIKE 'RI%') AS RI
            FROM edges WHERE shares_year GROUP BY {k}year)"""
    s["core"] = f"""
        SELECT {k}sum(mean) FILTER (indicator = 'PEI base') AS total_of_base,
               sum(mean) FILTER (indicator LIKE 'RI%') AS total_after_base,
               sum(mean) FILTER (indicator LIKE 'PEI%' AND indicator <> 'PEI base') AS total_at_end
        FROM edges WHERE shares_year IS NOT TRUE {group}"""
    changes = f"""
        SELECT {k}count(*) AS years, CASE WHEN count(*) = count(turnover) THEN sum(turnover) END AS change
        FROM turnover {group}"""
    join = f"LEFT JOIN changes USING ({kn})" if kn else "CROSS JOIN changes"
    s["changes"] = changes
    s["decomposed"] = f"""
        SELECT *, core_component - turnover_component AS decomposed_reduction FROM (
            SELECT {k}100 * (total_at_end - total_after_base) / total_of_base AS core_component,
                   100 * CASE WHEN coalesce(years, 0) = 0 THEN 0 ELSE change END / total_of_base AS turnover_component FROM core {join})"""
    s["latest"] = f"SELECT {k}max(year) AS year FROM eligible {group}"
    same = f"AND a.{kn} = b.{kn}" if kn else ""
    s["target_rows"] = f"SELECT a.* FROM yearly a JOIN latest b ON a.year > b.year - 3 {same}"
    s["target"] = f"""
        SELECT {k}{half_up("avg(mean)", 2)} AS target_PEI,
               sqrt(coalesce(sum(se_total * se_total), 0)) / 3 AS target_se_PEI FROM target_rows {group}"""
    matched = f"LEFT JOIN base USING ({kn}) LEFT JOIN target USING ({kn})" if kn else "CROSS JOIN base CROSS JOIN target"
    s["simplified"] = f"""
        SELECT *, 100 * (target_PEI - base_PEI) / base_PEI AS simplified_reduction FROM (
            SELECT {"latest." + k if k else ""}latest.year, PEI AS base_PEI, se_PEI AS base_se_PEI, target_PEI, target_se_PEI
            FROM latest {matched})"""
    s["true_change"] = f"SELECT {k}arg_max(coalesce(perc_change, 'NaN'), year) AS true_reduction FROM summary {group}"
    matched = f"JOIN simplified USING ({kn})" if kn else "CROSS JOIN simplified"
    s["error"] = f"""
        SELECT *, -100 * (true_reduction + simplified_reduction) / true_reduction AS relative_error
        FROM (SELECT {k}nullif(true_reduction, 'NaN') AS true_reduction, simplified_reduction FROM true_change {matched})"""
    return s


MEASURES = ("PEI", "delta_PEI", "delta_PEI_cumulative", "perc_change")
SUMMARY = ("PEI", "se_PEI", "delta_PEI", "se_delta_PEI", "delta_PEI_cumulative", "se_delta_PEI_cumulative")
PERCENT = ("perc_change", "se_perc_change")
BOUNDS = tuple(c for m in MEASURES for c in (m, f"ci_{m}_lower", f"ci_{m}_upper"))
ABSOLUTE = tuple(c for m in MEASURES for c in (m, f"ci_{m}"))
SITE_YEAR = (
    "site, year, round(mean, 9) + 0.0 AS mean, round(se_sampling_within_site, 9) + 0.0 AS se_sampling_within_site, "
    "round(capture, 9) + 0.0 AS capture, measurement"
)
STATION = "site_type, zone, start_date, end_date, operational_all_year"


def _needed(all_steps: dict[str, str], text: str) -> list[str]:
    """Steps that ``text`` builds on, in order."""
    names = list(all_steps)
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in names:
            if name in words and name not in found:
                found.add(name)
                todo.append(all_steps[name])
    return [n for n in names if n in found]


def _query(select: str, k: str = "", **options) -> str:
    all_steps = steps(k, **options)
    needed = _needed(all_steps, select)
    ctes = ",\n".join(f"{name} AS ({all_steps[name]})" for name in needed)
    return f"WITH {ctes}\n{select}" if ctes else select


def _doubles(names) -> str:
    return ", ".join(out(n) for n in names)


def _published(columns: dict[str, str], source: str) -> str:
    parts = [
        f'"{c}" AS "{header}"' if c == "year" else f'round(round_even({c}, 2), 9) + 0.0 AS "{header}"'
        for c, header in columns.items()
    ]
    return f"SELECT {', '.join(parts)} FROM {source}"


def oracle_sql() -> dict[str, str]:
    stats = f"{_doubles(('mean', 'se_total'))}, n_sites"
    each_site = "unnest(string_split(sites, '; ')) AS site"
    members_of_target = f"SELECT year, {each_site}, {stats} FROM target_rows"
    simplified = ("base_PEI", "base_se_PEI", "target_PEI", "target_se_PEI", "simplified_reduction")
    mean_columns = ("mean_RI", "mean_PEI", "se_RI", "se_PEI", "delta_PEI", "se_delta_PEI")
    station = "code, " + _doubles(("latitude", "longitude")) + ", site_type, zone, measurement, start_date, end_date"
    capture = f"""count(*) AS total_sites, count(*) FILTER (capture >= {THRESHOLD}) AS sites_meeting_threshold,
        round(round_even(100 * (count(*) FILTER (capture >= {THRESHOLD})) / count(*), 1), 9) + 0.0 AS percent_meeting_threshold
        FROM eligible WHERE operational_all_year AND year >= 1995"""
    components = ("total_of_base", "total_after_base", "total_at_end")
    decomposed = ("core_component", "turnover_component", "decomposed_reduction")
    detail = f"""SELECT i.site, code, {_doubles(("latitude", "longitude"))}, i.year, {out("mean")},
        {out("se_sampling_within_site", "se")}, {out("capture")}, e.measurement, e.site_type, e.zone
        FROM included i LEFT JOIN eligible e ON i.site = e.site AND i.year = e.year
            LEFT JOIN (SELECT site, measurement, code, latitude, longitude FROM stations) p
            ON p.site = i.site AND p.measurement = e.measurement
        QUALIFY NOT (e.measurement = 'Daily' AND bool_or(e.measurement = 'Hourly') OVER (PARTITION BY i.year, i.site))"""
    selects = {
        "scan_filtered_readings": "SELECT site, year, measurement, date, round(value, 9) + 0.0 AS value FROM readings "
        "WHERE year >= 1996 AND l_linenumber <> 7",
        "conform_schema": """SELECT CAST(NULL AS VARCHAR) AS network, CAST(NULL AS VARCHAR) AS source, year, date, site,
            CAST(NULL AS VARCHAR) AS code, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
            CAST(NULL AS VARCHAR) AS site_type, CAST(NULL AS VARCHAR) AS local_authority, CAST(NULL AS VARCHAR) AS zone,
            CAST(NULL AS VARCHAR) AS agglomeration, pollutant, measurement, averaging, CAST(NULL AS DOUBLE) AS data_capture,
            round(value, 9) + 0.0 AS value, 'Ratified' AS ratified FROM readings""",
        "accepted_readings": "SELECT site, year, count(value) AS n, round(sum(value), 9) + 0.0 AS total FROM checked "
        "WHERE faults = '' GROUP BY site, year",
        "rejected_readings": "SELECT faults, count(*) AS n FROM checked WHERE faults <> '' GROUP BY faults",
        "annual_site_stats": f"SELECT {SITE_YEAR} FROM annual",
        "annual_site_stats_from_batches": f"SELECT {SITE_YEAR} FROM annual",
        "renamed_metadata": "SELECT CASE WHEN latitude % 3 < 1 THEN site || ' (' || zone || ')' ELSE site END AS site, "
        f"{station} FROM stations",
        "eligible_after_first_year": f"""SELECT {SITE_YEAR}, {STATION} FROM eligible e WHERE NOT EXISTS (
            SELECT 1 FROM register r WHERE r.site = e.site AND longitude < 0 AND e.year < 1996 + floor(-longitude))""",
        "clean_metadata": "SELECT CASE site WHEN 'Supplier#000000003' THEN 'Supplier#000000003 (moved)' ELSE site END AS site, "
        f"{station} FROM stations",
        "operational_site_years": f"SELECT {SITE_YEAR}, {STATION} FROM operational",
        "prefer_hourly": f"""SELECT {SITE_YEAR}, {STATION} FROM eligible
            QUALIFY NOT (measurement = 'Daily' AND bool_or(measurement = 'Hourly') OVER (PARTITION BY year, site))""",
        "pei_annual": members_of_target,
        "pei_base": f"SELECT year, {_doubles(('PEI', 'se_PEI'))} FROM base",
        "cohort_members": "SELECT n AS increment_year, site, measurement, year, round(capture, 9) + 0.0 AS capture FROM cohorts",
        "increment_indicators": f"SELECT n AS increment_year, indicator, year, {stats} FROM increments",
        "increment_indicators_stepwise": f"SELECT n AS increment_year, indicator, year, {stats} FROM increments",
        "increment_deltas": f"SELECT n AS increment_year, {_doubles(mean_columns)} FROM deltas",
        "cumulative_change": f"SELECT n AS increment_year, {_doubles(mean_columns)}, {_doubles(SUMMARY[4:])} FROM cumulative",
        "reduction_summary": f"SELECT year, {_doubles(SUMMARY + PERCENT)} FROM summary",
        "confidence_half_widths": f"SELECT year, {_doubles(SUMMARY + PERCENT)}, {_doubles(f'ci_{m}' for m in MEASURES)} FROM intervals",
        "summary_with_bounds": f"SELECT year, {_doubles(BOUNDS)} FROM bounds",
        "summary_absolute": f"SELECT year, {_doubles(ABSOLUTE)} FROM intervals",
        "published_summary": _published(BOUNDS_HEADERS, "bounds"),
        "published_absolute": _published(ABSOLUTE_HEADERS, "intervals"),
        "indicator_table": f"SELECT indicator, year, {each_site}, {stats} FROM indicators",
        "indicator_members": "SELECT indicator, year, unnest(string_split(sites, '; ')) AS site FROM indicators",
        "sites_per_year": f"SELECT year, n_sites, {each_site} FROM fullest",
        "site_list_rows": "SELECT year, site FROM included",
        "site_detail": detail,
        "capture_statistics": f"SELECT year, {capture} GROUP BY year",
        "edge_rows": f"""SELECT indicator, year, {out("mean")}, n_sites, edge_before, edge_after, shares_year FROM edges""",
        "turnover_change": f"SELECT year, {_doubles(('PEI', 'RI', 'turnover'))} FROM turnover",
        "core_reduction": f"SELECT {_doubles(components)} FROM core",
        "decomposed_reduction": f"SELECT {_doubles(decomposed)} FROM decomposed",
        "simplified_reduction": "SELECT year, "
        + _doubles(simplified)
        + " FROM simplified",
        "relative_error": f"SELECT {_doubles(('true_reduction', 'simplified_reduction', 'relative_error'))} FROM error",
        "site_count_comparison": """SELECT t.year, t.n_sites AS simplified_sites, e.n_sites AS true_sites
            FROM target_rows t LEFT JOIN edges e ON t.year = e.year""",
    }
    by_zone = {
        "pei_base_by_zone": f"SELECT zone, year, {_doubles(('PEI', 'se_PEI'))} FROM base",
        "reduction_summary_by_zone": f"SELECT zone, year, {_doubles(SUMMARY + PERCENT)} FROM summary",
        "turnover_change_by_zone": f"SELECT zone, year, {_doubles(('PEI', 'RI', 'turnover'))} FROM turnover",
        "core_reduction_by_zone": f"SELECT zone, {_doubles(components)} FROM core",
        "simplified_reduction_by_zone": f"SELECT zone, year, {_doubles(simplified)} FROM simplified",
        "decomposed_reduction_by_zone": f"SELECT zone, {_doubles(decomposed)} FROM decomposed",
        "capture_statistics_by_zone": f"SELECT zone, year, {capture} GROUP BY zone, year",
        "indicator_table_by_zone": f"SELECT zone, indicator, year, {each_site}, {stats} FROM indicators",
        "sites_per_year_by_zone": f"SELECT zone, year, n_sites, {each_site} FROM fullest",
        "site_detail_by_zone": detail,
        "relative_error_by_zone": f"SELECT zone, {_doubles(('true_reduction', 'simplified_reduction', 'relative_error'))} FROM error",
        "site_count_comparison_by_zone": """SELECT t.zone, t.year, t.n_sites AS simplified_sites, e.n_sites AS true_sites
            FROM target_rows t LEFT JOIN edges e ON t.year = e.year AND t.zone = e.zone""",
    }
    empty, summary = (1980, 1982), _doubles(SUMMARY + PERCENT)
    variants = {
        "pei_annual_within_site_error": _query(members_of_target, within=True),
        "increment_indicators_within_site_error": _query(selects["increment_indicators"], within=True),
        "base_by_zone_without_data": _query(f"SELECT zone, year, {_doubles(('PEI', 'se_PEI'))} FROM base", "zone, ", base=empty),
        "base_by_zone_from_site_years": _query(f"SELECT zone, year, {_doubles(('PEI', 'se_PEI'))} FROM base", "zone, ", base=empty),
        "reduction_summary_without_base": _query(f"SELECT year, {summary} FROM summary", base=empty),
        "reduction_summary_without_base_by_zone": _query(f"SELECT zone, year, {summary} FROM summary", "zone, ", base=empty),
        "turnover_change_since_1995": _query(selects["turnover_change"], base=(1993, 1995)),
        "decomposed_reduction_since_1995": _query(selects["decomposed_reduction"], base=(1993, 1995)),
    }
    return {
        **variants,
        **{name: _query(select) for name, select in selects.items()},
        **{name: _query(select, "zone, ") for name, select in by_zone.items()},
        "eligible_site_years": _query(
            f"SELECT {SITE_YEAR}, {STATION} FROM eligible",
            exceptions={"Supplier#000000001": 1998, "Supplier#000000004": 1999},
        ),
    }
