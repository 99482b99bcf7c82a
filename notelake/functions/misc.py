"""Functions of no other kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid() -> Column:
    """A random UUID of version 4; another each time a row is computed."""
    return F.uuid()
