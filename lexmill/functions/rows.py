"""Helpers for expressions over one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row. Without it, Catalyst copies the expression into every place where
    body uses it, also into lambdas, where it would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
