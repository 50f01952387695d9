"""What both vector operators take for a usable vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """Not null, not empty, no null and no non-finite component."""
    fits = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & fits, F.lit(False))
