"""Weighted rendezvous sharding (operator 9).

Every record key ranks all shards by ``-weight / ln(u)``, ``u`` a hash of (key, shard) in (0, 1), and goes
to the greatest. A shard's score does not depend on the other shards, so adding one moves only the
records that now rank the new shard first: about ``w_new / sum(w)`` of them, all into the new shard.

Cases: a null key is a key like any other; null text has no bytes and checksum 0; repeated rows share
a shard and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.session import materialise


def _score(key: str, shard: Column, weight: Column) -> Column:
    hashed = F.xxhash64(F.col(key), shard.cast("int"))
    # 52 bits and a half are a double below one: the logarithm is never zero
    unit = (F.shiftrightunsigned(hashed, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -weight / F.log(unit)


def rendezvous(records: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """``records`` with ``shard`` and, with ``grown_weight``, ``grown_shard``: the shard once one more of that weight is added."""
    shards = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    best = F.array_max(F.transform(shards, lambda x: F.struct(_score(key, x.s, x.w).alias("score"), (-x.s).alias("minus"))))
    out = records.withColumn("_best", best).withColumn("shard", (-F.col("_best.minus")).cast("int"))
    if grown_weight is not None:
        n = len(weights)
        wins = _score(key, F.lit(n), F.lit(float(grown_weight))) > F.col("_best.score")
        out = out.withColumn("grown_shard", F.when(wins, F.lit(n)).otherwise(F.col("shard")).cast("int"))
    return out.drop("_best")


def with_slots(placed: DataFrame) -> DataFrame:
    """Gapless ``slot`` from 0 in each ``shard``, without bringing a shard into one task.

    Rows are written once with the number of the task that wrote them; counts per (shard, task) give
    each such cell its first slot, and only a cell's rows are ordered together.
    """
    marked = materialise(
        placed.withColumn("_task", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()), "sharded"
    )
    cells = marked.groupBy("shard", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("shard", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_task").orderBy("_nth")
    return (
        marked.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "_task"])
        .withColumn("slot", F.col("_start") + F.col("_row"))
        .drop("_task", "_nth", "_row", "_start")
    )


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: size, checksum, shard, slot and the shard after adding one."""
    sized = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    )
    placed = with_slots(rendezvous(sized, key, [1.0] * shards, 1.0))
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
