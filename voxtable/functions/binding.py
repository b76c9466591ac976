"""Taking the value of an expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often ``use`` names it.

    A column expression that is named twice stands twice in the plan, and expressions that are built
    on each other grow by powers; a lambda's variable stands for the value instead.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
