"""Per-key picks and shares built on map-side aggregation instead of windows.

``min_by`` over a struct combines before the shuffle, so a key that owns a third of the rows sends
one row per map task instead of all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in ``order`` (nulls first, ascending)."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def with_group_totals(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Attach group aggregates to every row (partial aggregation, then a join AQE can split)."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return df.join(totals, list(keys))


def mode_per_key(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: Column | None = None,
    out: str | None = None,
) -> DataFrame:
    """Commonest (or heaviest) value per key; ties go to the smallest value; null values ignored."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.alias("_amount"))
    )
    return counted.groupBy(*keys).agg(
        F.min_by(value, F.struct((-F.col("_amount")).alias("a"), F.col(value).alias("v"))).alias(
            out or value
        )
    )


def unique_mode_per_key(
    df: DataFrame, keys: Sequence[str], value: str, out: str | None = None, count: Column | None = None
) -> DataFrame:
    """Mode per key, null when two values share the first place."""
    amount = F.count(F.lit(1)) if count is None else F.sum(count)
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.alias("_amount"))
    ).where(F.col("_amount") > 0)
    low = F.min_by(value, F.struct((-F.col("_amount")).alias("a"), F.col(value).alias("v")))
    high = F.max_by(value, F.struct(F.col("_amount").alias("a"), F.col(value).alias("v")))
    # least and greatest of the values in the first place
    return counted.groupBy(*keys).agg(F.when(low == high, low).alias(out or value))


def sorted_text_list(value: Column, separator: str = ";") -> Column:
    """Sorted distinct non-blank texts of a group, joined; used after the values were deduplicated."""
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    return F.array_join(F.array_sort(F.collect_set(text)), separator)
