"""Order-dependent primitives that never sort one hot group in one task.

A Spark window needs all rows of a partition key in one task. Rankings, running totals and
previous-row lookups over a key that may hold a third of the table are therefore split by *range*:
rows are range-partitioned on the full order, each range is handled on its own, and a tiny table
with one row per range carries the totals (or the last row) across the boundaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.session import materialise

CHUNK = "_chunk"


def _as_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def range_chunks(df: DataFrame, order: Sequence[str | Column], chunks: int | None = None) -> DataFrame:
    """Range-partition on ``order`` and store the range number in ``_chunk``.

    The result is written out, so the range bounds (which Spark samples) are drawn exactly once.
    Without ``chunks`` there are as many ranges as shuffle partitions, and AQE merges neighbouring
    ones that are small.
    """
    columns = _as_columns(order)
    ranged = df.repartitionByRange(chunks, *columns) if chunks else df.repartitionByRange(*columns)
    ranged = ranged.withColumn(CHUNK, F.spark_partition_id())
    return materialise(ranged, "ranges")


def running_totals(df: DataFrame, order: Sequence[str | Column], columns: Sequence[str], chunks: int | None = None) -> DataFrame:
    """``columns`` replaced by their inclusive running totals over the whole table in ``order``."""
    ranged = range_chunks(df, order, chunks)
    # one row per range: bounded by the number of ranges, never by the data
    totals = ranged.groupBy(CHUNK).agg(*[F.sum(c).alias(f"_total_{c}") for c in columns])
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(CHUNK, *[F.coalesce(F.sum(f"_total_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in columns])
    inside = Window.partitionBy(CHUNK).orderBy(*_as_columns(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        ranged.join(F.broadcast(starts), CHUNK)
        .withColumns({c: F.col(f"_start_{c}") + F.sum(c).over(inside) for c in columns})
        .drop(CHUNK, *[f"_start_{c}" for c in columns])
    )


def running_total(
    df: DataFrame,
    order: Sequence[str | Column],
    value: Column,
    out: str,
    chunks: int | None = None,
) -> DataFrame:
    """Inclusive running total of ``value`` over the whole table in ``order``."""
    return running_totals(df.withColumn(out, value), order, [out], chunks)


def global_rank(
    df: DataFrame, order: Sequence[str | Column], out: str = "rank", chunks: int | None = None
) -> DataFrame:
    """1-based rank over the whole table; ``order`` has to be unique."""
    return running_total(df, order, F.lit(1).cast("long"), out, chunks)


def rank_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str = "rank",
    size: str | None = None,
) -> DataFrame:
    """``row_number`` per group without sorting a group in one task."""
    ranked = global_rank(df, [*keys, *order], "_global")
    aggregates = [F.min("_global").alias("_first")]
    if size:
        aggregates.append(F.count(F.lit(1)).alias(size))
    starts = ranked.groupBy(*keys).agg(*aggregates)
    condition = None
    right = starts
    for i, key in enumerate(keys):
        right = right.withColumnRenamed(key, f"_k{i}")
        test = F.col(key).eqNullSafe(F.col(f"_k{i}"))
        condition = test if condition is None else condition & test
    return (
        ranked.join(right, condition)
        .withColumn(out, F.col("_global") - F.col("_first") + 1)
        .drop("_global", "_first", *[f"_k{i}" for i in range(len(keys))])
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    chunks: int | None = None,
) -> DataFrame:
    """``lag`` of ``values`` (source column -> new column) inside each key, split by range."""
    full = [*keys, *order]
    ranged = range_chunks(df, full, chunks)
    carried = [*keys, *values]
    last = ranged.groupBy(CHUNK).agg(
        F.max_by(F.struct(*carried), F.struct(*full)).alias("_last")
    )
    # the preceding non-empty range; again one row per range
    w = Window.orderBy(CHUNK)
    edges = last.select(CHUNK, F.lag("_last").over(w).alias("_edge"))
    inside = Window.partitionBy(CHUNK).orderBy(*full)
    out = ranged.join(F.broadcast(edges), CHUNK).withColumn(
        "_prev", F.coalesce(F.lag(F.struct(*carried)).over(inside), F.col("_edge"))
    )
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_prev.{key}"))
    same = same & F.col("_prev").isNotNull()
    for source, target in values.items():
        out = out.withColumn(target, F.when(same, F.col(f"_prev.{source}")))
    return out.drop("_prev", "_edge", CHUNK)


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, fraction: float, out: str
) -> DataFrame:
    """Exact linearly interpolated percentile per group.

    Values are counted first (map-side), so copies of a value travel as one row; the cumulative
    counts come from :func:`running_total`. No task holds a group's distinct values.
    """
    marker = list(keys) or ["_all"]
    base = df.where(F.col(value).isNotNull())
    if not keys:
        base = base.withColumn("_all", F.lit(1))
    counted = base.groupBy(*marker, value).agg(F.count(F.lit(1)).alias("_n"))
    running = running_total(counted, [*marker, value], F.col("_n"), "_cum")
    groups = running.groupBy(*marker).agg(
        F.min(F.col("_cum") - F.col("_n")).alias("_before"), F.sum("_n").alias("_size")
    )
    placed = running.join(groups, marker)
    position = (F.col("_size") - 1) * F.lit(float(fraction))
    first = F.col("_cum") - F.col("_n") - F.col("_before")
    final = F.col("_cum") - F.col("_before") - 1
    low, high = F.floor(position), F.ceil(position)
    picked = placed.groupBy(*marker).agg(
        F.max(F.when(first.between(0, low) & (final >= low), F.col(value))).alias("_lo"),
        F.max(F.when((first <= high) & (final >= high), F.col(value))).alias("_hi"),
        F.max(position - low).alias("_part"),
    )
    result = picked.withColumn(out, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
    return result.select(*keys, out)
