"""Mixing sources to target weights by Pareto order sampling (operator 10).

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the total size; a
target stops at ``most`` times its source's size and the excess is reshared by weight until none is
above. The fixed point is ``min(most * size, level * weight)``, the level found from running sums over
one row per source.

A document expects ``m = weight * target / sum(weight * size)`` copies (weight 1 unless a column gives
others). ``floor(m)`` copies are certain; the fractional part is its inclusion probability ``p`` for one
more. Documents rank by ``u/(1-u) / (p/(1-p))`` (Pareto sampling: random odds over inclusion odds) and the sample
is the prefix of that order whose size comes nearest to what the certain copies leave of the target.
The random number is a hash of the document id, so reruns agree.

Cases: null text has size 0; a null source is a source; documents of size 0 take 0; repeated rows rank side by side and count each; empty
table, empty result. A hot source is never sorted in one task: ranks fall into ``BINS`` bins whose
sums are added up first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import unit_hash, word_count

BINS = 4096
MOST = 3


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` (and ``w``, summed to ``weighted``) rows; works on one row per source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("w")).alias("weighted"))
    # one row per source from here on, not one per document
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sources.withColumn("_w", (F.row_number().over(order) - 1) % 3 + 1)
    full = most * F.col("source_size")
    by_cap = Window.orderBy(full / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))) / F.sum("_w").over(onward)
    return weighed.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything)).select(
        "source", "source_size", "weighted", F.least(full.cast("double"), F.col("_level") * F.col("_w")).alias("target")
    )


def rank_bin(rank, copies, bins: int = BINS):
    """Bin of a rank, the bins of a source holding about as many documents each.

    A document of inclusion odds ``o`` has a rank below ``r`` with odds ``r * o``; ``copies``, the mean number of copies in the
    source, gives the typical odds (exactly those of all its documents where these weigh the same).
    """
    part = copies - F.floor(copies)
    typical = F.when((part > 0) & (part < 1), part / (1 - part)).otherwise(F.lit(1.0))
    scaled = rank * F.coalesce(typical, F.lit(1.0))
    return F.floor(scaled / (1 + scaled) * bins)


def pareto_mix(docs: DataFrame, size, key: str = "doc_id", source: str = "source", weight=None, salt: str = "mix", most: int = MOST, bins: int = BINS) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``.

    ``size``: column expression of a document's size; ``weight``: relative odds inside its source.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    base = docs.select(
        *own, F.coalesce(size, F.lit(0)).cast("long").alias("size"), unit_hash(F.col(key), salt).alias("_u"),
        (F.lit(1.0) if weight is None else weight).alias("_weight"),
    )
    targets = source_targets(base.select(F.col(source).alias("source"), "size", F.col("_weight").alias("w")), most)
    targets = targets.withColumnRenamed("source", "_source")
    met = base.join(targets, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    scale = F.when(F.col("weighted") > 0, F.col("target") / F.col("weighted")).otherwise(F.lit(0.0))
    met = met.withColumn("_m", F.least(F.lit(float(most)), scale * F.col("_weight")))
    met = met.withColumn("_whole", F.floor("_m")).withColumn("_p", F.col("_m") - F.col("_whole"))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    met = met.withColumn("_rank", F.when(F.col("_p") > 0, odds))
    # a document without a fractional part is outside
    met = met.withColumn("_bin", rank_bin(F.col("_rank"), F.least(F.lit(float(most)), F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), bins))
    sums = met.groupBy(F.col(source).alias("_source"), F.col("_bin").alias("_b")).agg(
        F.sum(F.when(F.col("_rank").isNotNull(), F.col("size"))).alias("_words"), F.sum(F.col("_whole") * F.col("size")).alias("_sure")
    )
    earlier = Window.partitionBy("_source").orderBy(F.col("_b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_source")
    sums = sums.select(
        "_source", "_b", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start"), F.sum("_sure").over(whole).alias("_certain")
    )
    met = met.join(sums, F.col(source).eqNullSafe(F.col("_source")) & F.col("_bin").eqNullSafe(F.col("_b"))).drop("_source", "_b")
    inside = Window.partitionBy(source, "_bin").orderBy("_rank", key).rowsBetween(Window.unboundedPreceding, -1)
    ranked = met.where(F.col("_rank").isNotNull()).withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    extra = F.when(F.col("_before") + F.col("size") / 2 <= F.col("target") - F.col("_certain"), F.lit(1)).otherwise(F.lit(0))
    mixed = ranked.withColumn("_extra", extra).drop("_before").unionByName(met.where(F.col("_rank").isNull()).withColumn("_extra", F.lit(0)))
    copies = (F.col("_whole") + F.col("_extra")).cast("long")
    return mixed.select(*own, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Digest of the mix: sizes, targets and words taken per document (text stays behind)."""
    sized = docs.select("doc_id", "source", word_count().alias("_words"))
    return pareto_mix(sized, F.col("_words")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def repeat_copies(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves, one row per copy, with the columns of ``docs``."""
    rows = docs.select("doc_id", "source", word_count().alias("_words"), F.struct(*docs.columns).alias("_row"))
    mixed = pareto_mix(rows, F.col("_words"))
    return mixed.where(F.col("copies") > 0).select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM s),
l AS (SELECT *, CAST((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(w) OVER (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (max(level) OVER ()) * w) AS target FROM l),
m AS (SELECT d.*, t.source_size, t.target, least(3.0::DOUBLE, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0::DOUBLE END) AS m
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, floor(m) AS whole, m - floor(m) AS p FROM m),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM r),
c AS (SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(CAST(whole AS BIGINT) * size) OVER (PARTITION BY source) AS certain FROM q),
k AS (SELECT *, CAST(whole AS BIGINT) + CASE WHEN rank IS NOT NULL AND CAST(before AS DOUBLE) + size / 2 <= target - CAST(certain AS DOUBLE) THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, source FROM k
"""
