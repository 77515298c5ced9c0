"""The indicator by plain Python loops, straight from the definition, for comparison on small frames."""

from __future__ import annotations

import math


def mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def sd(xs):
    xs = [x for x in xs if x is not None]
    if len(xs) < 2:
        return None
    m = sum(xs) / len(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / (len(xs) - 1))


def half_up(x, digits=0):
    if x is None:
        return None
    scale = 10**digits
    return math.copysign(math.floor(abs(x) * scale + 0.5 + 1.4901161193847656e-08) / scale, x)


def annual(rows, years, threshold=85):
    """{year: (mean, se, n, sites)} of the rows that count."""
    good = [
        r
        for r in rows
        if r["year"] in years and r["operational_all_year"] is True and r["capture"] is not None and r["capture"] >= threshold
    ]
    found = {}
    for year in sorted({r["year"] for r in good}):
        kept = []
        for r in good:
            if r["year"] != year:
                continue
            same = [o for o in good if o["year"] == year and o["site"] == r["site"]]
            if r["measurement"] == "Daily" and any(o["measurement"] == "Hourly" for o in same):
                continue
            kept.append(r)
        means = [r["mean"] for r in kept]
        spread = sd(means)
        se = None if spread is None else spread / math.sqrt(len(kept))
        found[year] = (mean(means), se, len(kept), sorted({r["site"] for r in kept}))
    return found


def cohort(rows, n, threshold=85):
    window = [r for r in rows if n - 3 <= r["year"] <= n]
    kept = []
    for r in window:
        own = [o for o in window if (o["site"], o["measurement"]) == (r["site"], r["measurement"])]
        if all(o["operational_all_year"] is True for o in own) and sum(o["capture"] >= threshold for o in own) >= 3:
            kept.append(r)
    return kept


def indicators(rows, base_year):
    """{(label, year): (mean, se, n, sites)} of the base window and all increments."""
    found = {("PEI base", y): v for y, v in annual(rows, range(base_year - 2, base_year + 1)).items()}
    for n in sorted({r["year"] for r in rows if r["year"] > base_year}):
        members = cohort(rows, n)
        for kind, years in (("RI", range(n - 3, n)), ("PEI", range(n - 2, n + 1))):
            found |= {(f"{kind} {n}", y): v for y, v in annual(members, years).items()}
    return found


def summary(rows, base_year):
    """{year: (PEI, se, delta, cumulative, percent)}."""
    table = indicators(rows, base_year)

    def three(label):
        found = [v for (name, _), v in table.items() if name == label]
        if not found:
            return None, None
        return mean([v[0] for v in found]), math.sqrt(sum(v[1] ** 2 for v in found if v[1] is not None)) / 3

    base, base_se = three("PEI base")
    base = half_up(base, 2)
    result = {base_year: (base, base_se, None, None, None)}
    total, variance = 0.0, 0.0
    for n in sorted({r["year"] for r in rows if r["year"] > base_year}):
        (ri, ri_se), (pei, pei_se) = three(f"RI {n}"), three(f"PEI {n}")
        if ri is None and pei is None:
            continue
        known = ri is not None and pei is not None and total is not None
        delta = half_up(ri - pei, 2) if ri is not None and pei is not None else None
        total = total + delta if known else None
        variance = variance + ri_se**2 + pei_se**2 if known and variance is not None else None
        if total is None or base is None:
            result[n] = (None, None, delta, total, None)
        else:
            result[n] = (
                base - total,
                math.sqrt(base_se**2 + variance),
                delta,
                total,
                half_up(100 * total / base, 2) if base else None,
            )
    return result
