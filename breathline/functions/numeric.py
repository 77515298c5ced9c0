"""Rounding, error propagation and NULL-aware sums.

Helpers take and give SQL expression text, to be used with ``F.expr``: the formulas of this package are long, and as
text they stay readable and reach Spark as one native expression each.
"""

from __future__ import annotations

# Fixed value: added before truncating, so that decimal ties such as 1.005 go up although the nearest double lies
# a little below the tie.  It is the square root of the double-precision epsilon.
TIE_GUARD = 1.4901161193847656e-08


def half_up(x: str, digits: int = 0) -> str:
    """Round to ``digits`` decimals, ties away from zero (``round`` has no guard against binary tie noise)."""
    scale = f"{10**digits}D"
    return f"(signum({x}) * floor(abs({x}) * {scale} + {0.5 + TIE_GUARD!r}D) / {scale})"


def quadrature(*errors: str) -> str:
    """Combined error of independent parts: the root of the summed squares; NULL if one part is NULL."""
    return f"sqrt({' + '.join(f'({e}) * ({e})' for e in errors)})"


def root_sum_of_squares(error: str) -> str:
    """Aggregate form of :func:`quadrature`; NULL parts count as 0, and so does an empty group."""
    return f"sqrt(coalesce(sum(({error}) * ({error})), 0D))"


def running_sum(x: str, window: str) -> str:
    """Running sum that turns NULL at the first NULL and stays so (``sum`` alone would step over it)."""
    return f"CASE WHEN count_if(({x}) IS NULL) OVER {window} = 0 THEN sum({x}) OVER {window} END"


def sum_or_null(x: str) -> str:
    """Sum that is NULL if any term is NULL, and 0 for no terms."""
    return f"CASE WHEN count_if(({x}) IS NULL) = 0 THEN coalesce(sum({x}), 0D) END"
