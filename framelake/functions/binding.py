"""A value bound once for a lambda.

What a lambda of a higher-order function refers to from outside is evaluated again for each element, and Catalyst may
move a column's expression there when it joins projections. let() makes the value an element itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once for a row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
