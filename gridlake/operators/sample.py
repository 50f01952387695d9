"""Stratified sampling of feeders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.ordered import global_rank, rank_in_group
from gridlake.operators.spatial import nearest_reference
from gridlake.session import materialise

SIZES = ("P", "M", "G")

# Reference points (region, lat, lon, radius km).
REFERENCES = (
    ("Centro", -22.905, -43.182, 1.8),
    ("Lapa/Glória", -22.917, -43.178, 1.0),
    ("Flamengo/Catete", -22.932, -43.176, 1.0),
    ("Laranjeiras/Cosme Velho", -22.937, -43.195, 1.2),
    ("Botafogo/Humaitá", -22.953, -43.188, 1.5),
    ("Copacabana/Leme", -22.970, -43.184, 1.6),
    ("Ipanema/Leblon", -22.984, -43.203, 1.4),
    ("Ipanema/Leblon", -22.984, -43.224, 1.4),
    ("Tijuca", -22.925, -43.235, 2.0),
    ("Vila Isabel/Grajaú", -22.917, -43.255, 1.8),
    ("Méier", -22.902, -43.280, 2.5),
    ("Jacarepaguá/Taquara", -22.925, -43.375, 3.5),
    ("Barra/Recreio", -23.003, -43.350, 4.0),
    ("Barra/Recreio", -23.022, -43.460, 4.0),
)


def size_class(df: DataFrame, value: str, key: str, labels: Sequence[str] = SIZES, out: str = "porte") -> DataFrame:
    """Equal-frequency classes of the rank of ``value`` (ties by ``key``), cut at interpolated
    quantiles of the rank (W3). Fewer distinct values than labels, fewer classes."""
    base = df.withColumn("_v", F.coalesce(F.col(value), F.lit(0)))
    ranked = materialise(global_rank(base, ["_v", key], "_r"), "ranked")
    totals = ranked.groupBy("_v").agg(F.count(F.lit(1)).alias("_c")).agg(
        F.sum("_c").alias("_n"), F.least(F.count(F.lit(1)), F.lit(len(labels))).alias("_q")
    )
    one = F.lit(1).alias("_one")
    joined = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(totals.select(one, "*")), "_one")
    # ceil((r - 1) * q / (n - 1)) in whole numbers
    step = F.floor(((F.col("_r") - 1) * F.col("_q") + F.col("_n") - 2) / F.nullif(F.col("_n") - 1, F.lit(0)))
    bin_no = F.when(F.col("_q") <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), step)).cast("int")
    names = F.array(*[F.lit(x) for x in labels])
    return joined.withColumn(out, F.element_at(names, bin_no)).drop("_v", "_r", "_one", "_n", "_q")


def sampling_universe(
    inventory: DataFrame, segments: DataFrame, town: str, references: Sequence[tuple] = REFERENCES
) -> DataFrame:
    """Feeders of a town with a region, their segment count and size class."""
    lat = (F.col("lat_min") + F.col("lat_max")) / 2
    lon = (F.col("lon_min") + F.col("lon_max")) / 2
    mine = nearest_reference(
        inventory.where(F.col("MUN").cast("string") == town), references, lat=lat, lon=lon, out="regiao"
    ).where(F.col("regiao").isNotNull())
    counts = segments.groupBy(F.col("CTMT").cast("string").alias("COD_ID")).agg(F.count(F.lit(1)).alias("n_trechos"))
    joined = mine.join(counts, "COD_ID", "left").withColumn("n_trechos", F.coalesce("n_trechos", F.lit(0)))
    return size_class(joined, "n_trechos", "COD_ID")


def strata_allocation(base: DataFrame, n: int, strata: Sequence[str] = ("regiao", "porte")) -> DataFrame:
    """Largest-remainder allocation of ``n`` over the strata (W4): strata, size, allocated.

    The strata table is the product of two short code lists; ranking its remainders in one task is
    bounded by that list. Remainders are compared as whole numbers.
    """
    sizes = base.groupBy(*strata).agg(F.count(F.lit(1)).alias("tamanho"))
    everything = Window.partitionBy(F.lit(1))
    quota = sizes.withColumn("_total", F.sum("tamanho").over(everything)).withColumns(
        {"_whole": F.floor(F.lit(n) * F.col("tamanho") / F.col("_total")), "_rest": (F.lit(n) * F.col("tamanho")) % F.col("_total")}
    )
    open_strata = F.col("_whole") < F.col("tamanho")
    left = F.lit(n) - F.sum("_whole").over(everything)
    order = Window.partitionBy(open_strata).orderBy(
        F.col("_rest").desc(), F.col("tamanho").desc(), *[F.col(s).desc() for s in strata]
    )
    ranked = quota.withColumn("_left", left).withColumn("_pos", F.row_number().over(order))
    extra = F.when(open_strata & (F.col("_pos") <= F.col("_left")), 1).otherwise(0)
    return ranked.select(*strata, "tamanho", (F.col("_whole") + extra).cast("long").alias("alocados"))


def stratified_sample(
    base: DataFrame, n: int, seed: int, key: str = "COD_ID", strata: Sequence[str] = ("regiao", "porte"), order: Column | None = None
) -> DataFrame:
    """Sample of ``n`` rows, allocated over strata, seeded order inside each.

    The order is ``sha2("seed:key")``: the same seed gives the same sample on any cluster and engine.
    """
    draw = order if order is not None else F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    drawn = base.withColumn("_rand", draw)
    ranked = rank_in_group(drawn, list(strata), ["_rand", key], "_r")
    picked = ranked.join(strata_allocation(base, n, strata).select(*strata, "alocados"), list(strata)).where(
        F.col("_r") <= F.col("alocados")
    )
    # n rows, as asked for by the caller
    number = Window.orderBy("_rand", *strata, key)
    return picked.withColumn("ordem_sorteio", F.row_number().over(number)).withColumn("seed", F.lit(seed)).drop("_rand", "_r", "alocados")
