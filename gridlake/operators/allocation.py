"""Allocation of registered generation to the network."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.columns import exact_sum, is_solar, number, text_or_empty, whole_number
from gridlake.functions.keyed import first_per_key, with_group_totals


def model_type(kind: str = "sig_tipo_geracao", source: str = "fonte_geracao"):
    """PVSystem for solar, Generator otherwise."""
    return F.when(is_solar(F.col(kind), F.col(source)), "PVSystem").otherwise("Generator")


def exact_allocation(
    register: DataFrame, base: DataFrame, *, code: str = "cod_empreendimento", base_code: str = "CEG_GD",
    power: str = "potencia_kw", weight: str = "POT_INST", keep: Sequence[str] = ("COD_ID", "CTMT", "PAC"),
    carry: Sequence[str] = (), scope: Sequence[str] = ("CTMT",),
) -> DataFrame:
    """Register kW split over the matching asset rows by installed kW, evenly when all are zero (L1).

    The split is inside ``scope`` (one feeder) and code. Totals come from a partial aggregation and a
    join, so a code with very many rows is not gathered anywhere.
    """
    unique = first_per_key(register.select(code, power, *carry), [code], [power, *carry])
    rows = base.withColumn("_code", text_or_empty(F.col(base_code))).where(F.col("_code") != "").withColumn(
        "_w", F.greatest(F.coalesce(number(F.col(weight)), F.lit(0.0)), F.lit(0.0)).cast("decimal(28,6)")
    )
    rows = rows.select("_code", "_w", *keep)
    totals = with_group_totals(rows, ["_code", *scope], _sum=F.sum("_w"), _n=F.count(F.lit(1)))
    share = F.when(F.col("_sum") > 0, F.col("_w").cast("double") / F.col("_sum").cast("double")).otherwise(F.lit(1.0) / F.col("_n"))
    return totals.join(unique.withColumnRenamed(code, "_code"), "_code").select(
        F.col("_code").alias("ceg_gd"), *keep, *carry, (F.col(power) * share).alias("potencia_alocada_kw")
    )


def load_by_feeder_town(layers: Sequence[DataFrame]) -> DataFrame:
    """Reference load per (feeder, town) and the town's total (A27); only positive loads with a
    known feeder and town."""
    parts = [
        df.select(
            text_or_empty(F.col("CTMT")).alias("CTMT"), whole_number(F.col("MUN")).alias("MUN"),
            number(F.col("CAR_INST")).alias("_w"),
        )
        for df in layers
    ]
    rows = reduce(DataFrame.unionByName, parts).where((F.col("CTMT") != "") & F.col("MUN").isNotNull() & (F.col("_w") > 0))
    load = rows.groupBy("CTMT", "MUN").agg(exact_sum(F.col("_w")).alias("carga_ref"))
    return with_group_totals(load, ["MUN"], carga_municipio=exact_sum(F.col("carga_ref")))


def unmatched_by_model(register: DataFrame, base: DataFrame) -> DataFrame:
    """Register rows without any base counterpart, by town and model type."""
    known = base.where(F.col("ceg_gd") != "").select(F.col("ceg_gd").alias("cod_empreendimento")).distinct()
    left = register.join(known, "cod_empreendimento", "left_anti").withColumn("tipo_modelo", model_type())
    return left.groupBy("cod_municipio_ibge", "municipio", "tipo_modelo").agg(
        F.count_distinct("cod_empreendimento").alias("n_empreendimentos"), exact_sum(F.col("potencia_kw")).alias("potencia_kw")
    )


def load_points(lv: DataFrame | None, mv: DataFrame | None) -> DataFrame:
    """Load points of each feeder with their share of its load: LV transformers and MV nodes."""
    parts = []
    if lv is not None:
        parts.append(
            lv.select(
                "CTMT", F.lit("BT").alias("grupo"), text_or_empty(F.col("UNI_TR_MT")).alias("id_ref"),
                F.lit("").alias("fas_con"), F.lit("").alias("ten_con"), number(F.col("CAR_INST")).alias("_w"),
            )
        )
    if mv is not None:
        parts.append(
            mv.select(
                "CTMT", F.lit("MT").alias("grupo"), text_or_empty(F.col("PAC")).alias("id_ref"),
                text_or_empty(F.col("FAS_CON")).alias("fas_con"), text_or_empty(F.col("TEN_FORN")).alias("ten_con"),
                number(F.col("CAR_INST")).alias("_w"),
            )
        )
    rows = reduce(DataFrame.unionByName, parts).where((F.col("id_ref") != "") & (F.col("_w") > 0))
    weights = rows.groupBy("CTMT", "grupo", "id_ref", "fas_con", "ten_con").agg(exact_sum(F.col("_w")).alias("peso"))
    return with_group_totals(weights, ["CTMT"], peso_total=exact_sum(F.col("peso")))


def residual_allocation(residue: DataFrame, load: DataFrame, points: DataFrame) -> DataFrame:
    """Residue of a town spread over feeders by load and over a feeder's points by load (L2).

    ``residue``: MUN, municipio, tipo_modelo, n_empreendimentos, potencia_kw; ``load``: CTMT, MUN,
    carga_ref, carga_municipio; ``points``: CTMT, grupo, id_ref, fas_con, ten_con, peso, peso_total.
    """
    share = F.when(F.col("carga_municipio") > 0, F.col("carga_ref") / F.col("carga_municipio")).otherwise(F.lit(0.0))
    by_feeder = load.join(residue, "MUN").withColumn("kw_alimentador", F.col("potencia_kw") * share).where(F.col("kw_alimentador") > 0)
    return by_feeder.join(points.where(F.col("peso_total") > 0), "CTMT").select(
        "CTMT", "MUN", "municipio", "tipo_modelo", "n_empreendimentos", "grupo", "id_ref", "fas_con", "ten_con",
        (F.col("kw_alimentador") * F.col("peso") / F.col("peso_total")).alias("potencia_alocada_kw"),
    )


def allocation_summary(exact: DataFrame, residual: DataFrame) -> DataFrame:
    """Elements, projects and kW per feeder by method (L3)."""
    a = exact.groupBy("CTMT").agg(
        F.count(F.lit(1)).alias("n_elementos_exatos"), F.count_distinct("ceg_gd").alias("n_empreendimentos_exatos"),
        exact_sum(F.col("potencia_alocada_kw"), 9).alias("potencia_exata_kw"),
    )
    b = residual.groupBy("CTMT").agg(
        F.count(F.lit(1)).alias("n_elementos_agregados"), exact_sum(F.col("potencia_alocada_kw"), 9).alias("potencia_agregada_kw")
    )
    groups = residual.select("CTMT", "MUN", "tipo_modelo", "n_empreendimentos").distinct().groupBy("CTMT").agg(
        F.sum("n_empreendimentos").alias("n_empreendimentos_agregados")
    )
    out = a.join(b, "CTMT", "full").join(groups, "CTMT", "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in out.columns if c.startswith("n_")}
    floats = {c: F.coalesce(c, F.lit(0.0)) for c in out.columns if c.startswith("potencia")}
    out = out.withColumns({**zeros, **floats})
    return out.withColumns(
        {
            "n_elementos": F.col("n_elementos_exatos") + F.col("n_elementos_agregados"),
            "potencia_total_kw": F.col("potencia_exata_kw") + F.col("potencia_agregada_kw"),
        }
    )
