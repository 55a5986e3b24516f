"""A value that is worked out once, however often an expression names it.

Spark computes common parts of an expression once, but not within the
functions of ``transform`` and ``filter``: what they name is worked out again
at each place and for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
