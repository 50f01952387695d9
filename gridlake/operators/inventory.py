"""One row per feeder: extent, load, customers, switches, ties, generation, score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.columns import (
    ENERGY,
    first_word,
    kilovolts,
    number,
    round_to,
    sum_of_present,
)
from gridlake.functions.geo import with_shape
from gridlake.functions.keyed import first_per_key
from gridlake.operators.spatial import lines_meeting_areas
from gridlake.operators.ties import RADIUS_M, detect_ties, symmetric_counts
from gridlake.sources.catalog import LayerCatalog, MissingLayer

# Column order of the inventory.
INVENTORY_COLUMNS = [
    "COD_ID", "NOME", "tipo", "SUB", "SUB_NOME", "UNI_TR_AT", "TEN_NOM", "TEN_NOM_kV", "MUN",
    "km_MT", "ENE_MWh_ano", "ENE_UC_MWh_ano", "n_UNTRMT", "kVA_instalado", "n_UCBT", "n_UCMT",
    "n_DER", "kW_DER", "chaves_total", "chaves_NA", "chaves_NF", "chaves_telecomandadas",
    "NA_interligacao", "NA_interligacao_telecomandada", "NA_interligacao_SE",
    "NA_interligacao_campo", "NA_interligacao_campo_telecomandada", "n_vizinhos", "vizinhos",
    "n_UNREMT", "n_UNCRMT", "lon_min", "lat_min", "lon_max", "lat_max", "score",
]
COUNT_COLUMNS = [
    "n_UNTRMT", "n_UCBT", "n_UCMT", "n_DER", "chaves_total", "chaves_NA", "chaves_NF",
    "chaves_telecomandadas", "NA_interligacao", "NA_interligacao_telecomandada",
    "NA_interligacao_SE", "NA_interligacao_campo", "NA_interligacao_campo_telecomandada",
    "n_vizinhos", "n_UNREMT", "n_UNCRMT",
]


#: Sums go through decimals, so they do not depend on the order of partitions.
EXACT = "decimal(28,6)"


def effective_key(
    rows: DataFrame,
    mapping: DataFrame | None,
    *,
    via: str = "UNI_TR_MT",
    own: str = "CTMT",
    map_id: str = "COD_ID",
    map_value: str = "CTMT",
    out: str = "ctmt_efetivo",
) -> DataFrame:
    """Key of a row: the mapped one (feeder of its transformer) if known, else its own (P5)."""
    if mapping is None or via not in rows.columns:
        return rows.withColumn(out, F.col(own))
    table = mapping.select(F.col(map_id).alias(via), F.col(map_value).alias("_mapped"))
    joined = rows.join(table, via, "left")
    own_value = F.col(own) if own in rows.columns else F.lit(None)
    return joined.withColumn(out, F.coalesce(F.col("_mapped"), own_value)).drop("_mapped")


def transformer_map(transformers: DataFrame) -> DataFrame:
    """Transformer -> feeder, one row per transformer."""
    return first_per_key(transformers.select("COD_ID", "CTMT"), ["COD_ID"], ["CTMT"])


def _counted(rows: DataFrame, mapping: DataFrame | None, value: Column, count: str, total: str) -> DataFrame:
    """CTMT, count, exact total per effective feeder and own transformer.

    Rows are counted per (transformer, own feeder) first, so only those totals meet the transformers.
    """
    keys = [c for c in ("UNI_TR_MT", "CTMT") if c in rows.columns and (c == "CTMT" or mapping is not None)]
    small = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), F.sum(value.cast(EXACT)).alias(total))
    return effective_key(small, mapping).select(F.col("ctmt_efetivo").alias("CTMT"), count, total)


def _kwh(rows: DataFrame, energy: Sequence[str] = tuple(ENERGY)) -> Column:
    present = [F.col(c) for c in energy if c in rows.columns]
    return sum_of_present(present) if present else F.lit(None).cast("double")


def customers_by_feeder(
    customers: DataFrame, mapping: DataFrame | None, energy: Sequence[str] = tuple(ENERGY)
) -> DataFrame:
    """Customers and yearly kWh per effective feeder (A3)."""
    return _counted(customers, mapping, _kwh(customers, energy), "n", "kwh").groupBy("CTMT").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum("kwh").cast("double"), F.lit(0.0)).alias("kwh")
    )


def generators_by_feeder(generators: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """Generators and installed kW per effective feeder (A4)."""
    return _counted(generators, mapping, F.col("POT_INST"), "n", "kw").groupBy("CTMT").agg(
        F.sum("n").alias("n"), F.sum("kw").cast("double").alias("kw")
    )


def feeder_attributes(feeders: DataFrame) -> DataFrame:
    """Type (first word of the name), nominal kV and yearly MWh of each feeder."""
    return feeders.select(
        "COD_ID",
        F.coalesce(F.col("NOME"), F.lit("")).alias("NOME"),
        first_word(F.coalesce(F.col("NOME"), F.lit(""))).alias("tipo"),
        "SUB", "UNI_TR_AT",
        F.col("TEN_NOM").cast("string").alias("TEN_NOM"),
        kilovolts(F.col("TEN_NOM")).alias("TEN_NOM_kV"),
        (sum_of_present([F.col(c) for c in ENERGY]) / 1000.0).alias("ENE_MWh_ano"),
    )


def switch_counts(switches: DataFrame) -> DataFrame:
    """Switches per feeder: total, open, closed, remote (A2); state tested without trimming."""
    return switches.groupBy("CTMT").agg(
        F.count(F.lit(1)).alias("chaves_total"),
        F.count_if(F.col("P_N_OPE") == "A").alias("chaves_NA"),
        F.count_if(F.col("P_N_OPE") == "F").alias("chaves_NF"),
        F.count_if(number(F.col("TLCD")) == 1).alias("chaves_telecomandadas"),
    )


def feeder_inventory(
    catalog: LayerCatalog,
    *,
    radius_m: float = RADIUS_M,
    area: DataFrame | None = None,
    ties: DataFrame | None = None,
    central_meridian: float = -45.0,
    area_cell: float = 0.01,
) -> DataFrame:
    """The feeder inventory (A1): one tagged union of all layers, one aggregate per feeder, one join with the feeders.

    ``CTMT`` and ``SSDMT`` are required, everything else is optional and counts zero when absent.
    ``area`` (area_id, edges, extent) keeps feeders with a segment touching it; ties are always
    detected over all feeders. A computed ``ties`` table may be passed in to avoid detecting twice.
    """
    for required in ("CTMT", "SSDMT"):
        if not catalog.has(required):
            raise MissingLayer(f"layer {required} is required")
    feeders = feeder_attributes(
        catalog.table("CTMT", ["COD_ID", "NOME", "SUB", "UNI_TR_AT", "TEN_NOM", *ENERGY])
    )
    segments = catalog.table("SSDMT", ["COD_ID", "CTMT", "PAC_1", "PAC_2", "COMP", "geometry"])
    shaped = with_shape(segments.select("CTMT", "COMP", "geometry")).select("CTMT", "COMP", "shape.*")
    if area is not None:
        touched = lines_meeting_areas(
            shaped.where(F.size("edges") > 0), area, cell=area_cell
        ).select(F.col("CTMT").alias("COD_ID")).distinct()
        feeders = feeders.join(touched, "COD_ID", "left_semi")

    transformers = catalog.table("UNTRMT", ["COD_ID", "CTMT", "POT_NOM", "MUN"])
    # transformers of feeders outside the selection do not take part in the effective key
    known = feeders.select(F.col("COD_ID").alias("CTMT"))
    transformers = transformers.join(known, "CTMT", "left_semi")
    mapping = transformer_map(transformers) if catalog.has("UNTRMT") else None

    switches = catalog.table(
        "UNSEMT", ["COD_ID", "CTMT", "P_N_OPE", "TLCD", "TIP_UNID", "MUN", "geometry"]
    )
    if ties is None and catalog.has("UNSEMT"):
        substations = catalog.read("SUB", ["COD_ID"]) if catalog.has("SUB") else None
        ties = detect_ties(
            switches, segments, substations, radius_m=radius_m, central_meridian=central_meridian
        )
    tie_columns = COUNT_COLUMNS[8:14]

    one = F.lit(1).cast("long")
    gen = ["COD_ID", "UNI_TR_MT", "CTMT", "POT_INST"]
    lv = catalog.table("UCBT_tab", ["COD_ID", "UNI_TR_MT", "CTMT", *ENERGY])
    mv = catalog.table("UCMT_tab", ["COD_ID", "CTMT", *ENERGY])
    parts = [
        shaped.select("CTMT", F.col("COMP").cast(EXACT).alias("_m"), "minx", "miny", "maxx", "maxy"),
        transformers.select("CTMT", one.alias("n_UNTRMT"), F.col("POT_NOM").cast(EXACT).alias("kVA_instalado"), F.col("MUN").alias("_mun_t")),
        switches.select(
            "CTMT", one.alias("chaves_total"), (F.col("P_N_OPE") == "A").cast("long").alias("chaves_NA"), (F.col("P_N_OPE") == "F").cast("long").alias("chaves_NF"),
            (number(F.col("TLCD")) == 1).cast("long").alias("chaves_telecomandadas"), F.col("MUN").alias("_mun_s")),
        _counted(lv, mapping, _kwh(lv), "n_UCBT", "_kwh_bt"),
        mv.select("CTMT", one.alias("n_UCMT"), _kwh(mv).cast(EXACT).alias("_kwh_mt")),
        _counted(catalog.table("UGBT_tab", gen), mapping, F.col("POT_INST"), "_g_bt", "_kw_bt"),
        catalog.table("UGMT_tab", ["COD_ID", "CTMT", "POT_INST"]).select("CTMT", one.alias("_g_mt"), F.col("POT_INST").cast(EXACT).alias("_kw_mt")),
        *[catalog.table(layer, ["COD_ID", "CTMT"]).select("CTMT", one.alias(f"n_{layer}")) for layer in ("UNREMT", "UNCRMT")],
    ]
    if ties is not None:
        parts.append(symmetric_counts(ties))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).where(F.col("CTMT").isNotNull())
    special = {"minx", "miny", "maxx", "maxy", "_mun_t", "_mun_s", "vizinhos", "CTMT"}
    whole = [c for c in rows.columns if c not in special]
    exact = {f.name for f in rows.schema.fields if f.dataType.typeName() == "decimal"}
    table = rows.groupBy(F.col("CTMT").alias("COD_ID")).agg(
        *[(F.sum(c).cast("double") if c in exact else F.sum(c)).alias(c) for c in whole],
        *[round_to(how(side), 6).alias(name) for how, side, name in (
            (F.min, "minx", "lon_min"), (F.min, "miny", "lat_min"), (F.max, "maxx", "lon_max"), (F.max, "maxy", "lat_max"))],
        # commonest value, the smallest of several
        *[F.mode(c, True).alias(c) for c in ("_mun_t", "_mun_s")],
        *([F.max("vizinhos").alias("vizinhos")] if ties is not None else []),
    ).withColumn("km_MT", F.col("_m") / 1000.0)
    table = feeders.join(table, "COD_ID", "left")
    if catalog.has("SUB"):
        names = first_per_key(catalog.table("SUB", ["COD_ID", "NOME"]), ["COD_ID"], ["NOME"])
        table = table.join(
            names.select(F.col("COD_ID").alias("SUB"), F.col("NOME").alias("SUB_NOME")), "SUB", "left"
        )
    else:
        table = table.withColumn("SUB_NOME", F.lit(None).cast("string"))
    return finish_inventory(table, tie_columns if ties is None else ())


def finish_inventory(table: DataFrame, absent: Sequence[str] = ()) -> DataFrame:
    """Zero-fill, rounding and score of the joined aggregates."""

    def zero(name: str):
        return F.coalesce(F.col(name), F.lit(0)) if name in table.columns else F.lit(0)

    def zero_float(*names: str):
        total = F.lit(0.0)
        for name in names:
            total = total + F.coalesce(F.col(name), F.lit(0.0))
        return total

    neighbours = F.lit("") if absent else F.coalesce(F.col("vizinhos"), F.lit(""))
    special = {
        "MUN": F.coalesce(F.col("_mun_t"), F.col("_mun_s")),
        "km_MT": round_to(zero_float("km_MT"), 3),
        "ENE_MWh_ano": round_to(F.col("ENE_MWh_ano"), 3),
        "ENE_UC_MWh_ano": round_to(zero_float("_kwh_bt", "_kwh_mt") / 1000.0, 3),
        "kVA_instalado": round_to(zero_float("kVA_instalado"), 3),
        "kW_DER": round_to(zero_float("_kw_bt", "_kw_mt"), 3),
        "n_DER": (zero("_g_bt") + zero("_g_mt")),
        "vizinhos": neighbours,
        "score": zero("NA_interligacao_campo") * (zero("n_UCBT") + zero("n_UCMT")),
    }
    columns = []
    for name in INVENTORY_COLUMNS:
        value = special.get(name)
        if value is None:
            value = zero(name) if name in COUNT_COLUMNS else F.col(name)
        if name in COUNT_COLUMNS or name == "score":
            value = value.cast("long")
        columns.append(value.alias(name))
    return table.select(*columns)


def top_feeders(inventory: DataFrame, n: int | None = None) -> DataFrame:
    """Inventory order: score, field ties, LV customers descending, code ascending."""
    ordered = inventory.orderBy(
        F.col("score").desc(), F.col("NA_interligacao_campo").desc(), F.col("n_UCBT").desc(), "COD_ID"
    )
    return ordered if n is None else ordered.limit(n)
