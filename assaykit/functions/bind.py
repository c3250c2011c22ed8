"""Evaluate an expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once: branches of a ``when`` would each evaluate it again."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)
