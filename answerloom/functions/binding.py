"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once.

    A column that a lambda refers to may be inlined by the optimizer and then
    computed again for every element. A lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
