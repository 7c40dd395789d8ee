"""Checks that fail a query at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def required(value: Column, condition: Column, message: str, kind: str = "long") -> Column:
    """value where the condition holds; any other row fails the query.

    A value, not a filter: the optimizer may copy a filter's predicate to rows that other filters have not seen yet.
    """
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast(kind))
