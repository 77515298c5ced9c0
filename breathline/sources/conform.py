"""Bring a readings frame of any origin into the standard layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import STANDARD_NAME_FOR, STANDARD_READINGS


def _origins(df: DataFrame) -> dict[str, str]:
    """The column of ``df`` that each standard column comes from, for those that it has."""
    origin: dict[str, str] = {}
    for name in df.columns:
        origin.setdefault(STANDARD_NAME_FOR.get(name, name), name)
    return {f.name: origin[f.name] for f in STANDARD_READINGS if f.name in origin}


def conform_readings(df: DataFrame) -> DataFrame:
    """The standard columns in the standard order: older names replaced, extra columns dropped, absent ones NULL.

    If an older and a standard name both occur, the one that comes first in ``df`` is used.
    """
    origin = _origins(df)
    return df.select(
        *[
            (F.col(f"`{origin[f.name]}`") if f.name in origin else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in STANDARD_READINGS
        ]
    )


def checked_readings(df: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """:func:`conform_readings` for input that may hold bad values, with ``faults``: why a row is no reading.

    A value that its column's type cannot take becomes NULL, and the fault is ``<column>: <value>``; a ``required`` column
    that is NULL, or not there at all, is the fault ``<column>: missing``.  A row without faults has an empty list.  It is
    one projection; :func:`accepted` and :func:`rejected` split its rows.
    """
    origin = _origins(df)
    columns, faults = [], []
    for f in STANDARD_READINGS:
        given = F.col(f"`{origin[f.name]}`") if f.name in origin else F.lit(None)
        value = given.try_cast(f.dataType)
        columns.append(value.alias(f.name))
        told = F.concat(F.lit(f"{f.name}: "), given.cast("string"))
        fault = F.when(given.isNotNull() & value.isNull(), told)
        if f.name in required:
            fault = fault.when(value.isNull(), F.lit(f"{f.name}: missing"))
        faults.append(fault)
    return df.select(*columns, F.array_compact(F.array(*faults)).alias("faults"))


def accepted(checked: DataFrame) -> DataFrame:
    """Rows without faults, in the standard layout."""
    return checked.where("size(faults) = 0").drop("faults")


def rejected(checked: DataFrame) -> DataFrame:
    """Rows with faults, and what was good about them."""
    return checked.where("size(faults) > 0")
