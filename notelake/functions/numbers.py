"""Number functions on columns; results stay doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(v: Column, rounded: Column) -> Column:
    """A rounded double: from 2**52 on, as for NaN, v is what it was, and zeros have the sign of v."""
    v = v.cast("double")
    inner = F.when(v == 0, v).when((rounded == 0) & (v < 0), F.lit(-0.0)).otherwise(rounded.cast("double"))
    return F.when(F.abs(v) < 2.0**52, inner).otherwise(v)


def ceil(v: Column) -> Column:
    return _whole(v, F.ceil(v))


def floor(v: Column) -> Column:
    return _whole(v, F.floor(v))


def sqrt(v: Column) -> Column:
    """An error for negative numbers."""
    return F.when(v < 0, F.raise_error(F.concat(F.lit("sqrt of a negative number: "), v.cast("string")))).otherwise(F.sqrt(v))


def num_format(v: Column, decimals: int = 2) -> Column:
    """So many decimals and no grouping; ties go to the even digit."""
    text = F.format_number(v, decimals)
    return F.regexp_replace(text, ",", "")
