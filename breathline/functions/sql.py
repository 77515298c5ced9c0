"""SQL text of windows and literals.

A window per series alone (no further partition column) is only for frames that are down to a few rows per series and
year.  With a single series Spark warns that such a window has one partition; that partition is as long as the years
are many.  Everything after it is then done in place: later groups and windows of the same series need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable


def text(value: str) -> str:
    """A string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def quoted(names: Iterable[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def window(partition: Iterable[str], order: str = "", frame: str = "") -> str:
    """``(PARTITION BY .. ORDER BY .. frame)``; empty parts are left out."""
    columns = quoted(partition)
    parts = [f"PARTITION BY {columns}" if columns else "", f"ORDER BY {order}" if order else "", frame]
    return f"({' '.join(p for p in parts if p)})"
