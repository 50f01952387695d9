"""Sinks: result tables and map features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.columns import kilovolts, switch_type, text_or_empty, text_or_null
from gridlake.functions.keyed import first_per_key, mode_per_key


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Result table as CSV with header, parquet or JSON (S14); one file per partition."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


# --- features (S9, P8, A24) ----------------------------------------------------------------------


def point_json(x: Column, y: Column) -> Column:
    return F.when(
        x.isNotNull() & y.isNotNull(),
        F.concat(F.lit('{"type":"Point","coordinates":['), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]}")),
    )


def line_json(parts: Column) -> Column:
    """Edge array of one line to a LineString: starts of the edges plus the last end."""

    def pair(x, y):
        return F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))

    starts = F.transform(parts, lambda e: pair(e.x1, e.y1))
    last = F.element_at(parts, -1)
    return F.when(
        F.size(parts) > 0,
        F.concat(F.lit('{"type":"LineString","coordinates":['), F.array_join(F.concat(starts, F.array(pair(last["x2"], last["y2"]))), ","), F.lit("]}")),
    )


def feature_lines(df: DataFrame, layer: str, properties: Sequence[str], geometry: Column, min_zoom: int) -> DataFrame:
    """One GeoJSON feature per row as text (S9): selected properties, nulls kept, minimum zoom."""
    props = F.to_json(F.struct(*[c for c in properties if c in df.columns]), {"ignoreNullFields": "false"})
    return df.where(geometry.isNotNull()).select(
        F.concat(
            F.lit('{"type":"Feature","tippecanoe":{"minzoom":'), F.lit(str(min_zoom)), F.lit(',"layer":"'), F.lit(layer),
            F.lit('"},"properties":'), props, F.lit(',"geometry":'), geometry, F.lit("}"),
        ).alias("value")
    )


def write_features(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def segment_attributes(segments: DataFrame, feeders: DataFrame) -> DataFrame:
    """kV and feeder name on segments."""
    names = first_per_key(
        feeders.select(F.trim("COD_ID").alias("_f"), kilovolts(F.col("TEN_NOM")).alias("TEN_KV"), F.col("NOME").alias("NOME_CTMT")), ["_f"], ["NOME_CTMT"]
    )
    return segments.withColumn("_f", F.trim("CTMT")).join(names, "_f", "left").drop("_f")


def switch_attributes(switches: DataFrame, ties: DataFrame) -> DataFrame:
    """Type text, tie flag, neighbour and in-substation flag on switches (P8); the nearest
    neighbour (then the smaller code) stands for a switch with several."""
    first = first_per_key(
        ties.select(F.trim("COD_ID").alias("_c"), "CTMT_VIZ", "EM_SUB", "DIST_M"), ["_c"], ["DIST_M", "CTMT_VIZ"]
    ).drop("DIST_M")
    joined = switches.withColumn("_c", F.trim("COD_ID")).join(first, "_c", "left")
    return joined.withColumns({"TIPO": switch_type(F.col("TIP_UNID")), "TIE": F.col("CTMT_VIZ").isNotNull()}).drop("_c")


def transformer_attributes(transformers: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers per transformer."""
    counts = customers.groupBy(F.trim(F.col("UNI_TR_MT").cast("string")).alias("_c")).agg(F.count(F.lit(1)).alias("N_UCBT"))
    return transformers.withColumn("_c", F.trim("COD_ID")).join(counts, "_c", "left").withColumn("N_UCBT", F.coalesce("N_UCBT", F.lit(0))).drop("_c")


def customers_per_pole(customers: DataFrame, pole: str = "PN_CON", modes: Sequence[str] = ("CTMT", "UNI_TR_MT", "CLAS_SUB")) -> DataFrame:
    """Customers per pole with modal feeder, transformer and class."""
    rows = customers.select(text_or_null(F.col(pole)).alias(pole), *[text_or_empty(F.col(m)).alias(m) if m != pole else F.col(m) for m in modes]).where(F.col(pole).isNotNull())
    rows = rows.withColumns({m: F.nullif(F.col(m), F.lit("")) for m in modes})
    out = rows.groupBy(pole).agg(F.count(F.lit(1)).alias("N_UC"))
    for m in modes:
        out = out.join(mode_per_key(rows, [pole], m), pole, "left")
    return out


def poles_with_customers(per_pole: DataFrame, poles: DataFrame, pole: str = "PN_CON") -> tuple[DataFrame, DataFrame]:
    """(rows whose pole exists, rows whose pole is lost)."""
    known = poles.select(F.trim(F.col("COD_ID").cast("string")).alias(pole)).distinct()
    return per_pole.join(known, pole, "left_semi"), per_pole.join(known, pole, "left_anti")


# --- network state (S10) -------------------------------------------------------------------------


def network_state(edges: DataFrame, fed: DataFrame, transformers: DataFrame | None = None, customers: DataFrame | None = None) -> DataFrame:
    """Segments, switches, foreign switches and transformers with ``energizado`` and ``fonte``.

    A switch is live when either side is; an external one when its network side is.
    """
    a = fed.select(F.col("node").alias("src"), F.col("fed_by").alias("_a"))
    b = fed.select(F.col("node").alias("dst"), F.col("fed_by").alias("_b"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left")
    ties = edges.where(F.col("kind") == "tie").select(F.substring_index("edge_id", "|", 1).alias("edge_id"), F.lit(True).alias("_tie")).distinct()
    joined = joined.where(F.col("kind") != "tie").join(ties, "edge_id", "left")
    segment = F.col("kind") == "trecho"
    source = F.when(segment | F.col("external"), F.col("_a")).otherwise(F.coalesce("_a", "_b"))
    columns = ["camada", "COD_ID", "CTMT", "PAC_1", "PAC_2", "normal", "aberta", "TLCD", "tie", "externa", "energizado", "fonte", "valor", "n_UCBT"]
    state = joined.select(
        F.when(segment, "SSDMT").otherwise("UNSEMT").alias("camada"), F.col("edge_id").alias("COD_ID"), F.col("ctmt").alias("CTMT"),
        F.col("src").alias("PAC_1"), F.col("dst").alias("PAC_2"), "normal", F.when(~segment, F.col("open")).alias("aberta"),
        F.when(~segment, F.col("tlcd")).alias("TLCD"), F.when(~segment, F.col("external") | F.coalesce("_tie", F.lit(False))).alias("tie"),
        F.col("external").alias("externa"), source.isNotNull().alias("energizado"), source.alias("fonte"),
        F.when(segment, F.col("comp")).alias("valor"), F.lit(None).cast("long").alias("n_UCBT"),
    )
    if transformers is None:
        return state.select(*columns)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("PAC_1")).distinct()
    t = transformers.select(F.trim("COD_ID").alias("COD_ID"), "CTMT", F.trim("PAC_1").alias("PAC_1"), F.col("POT_NOM").cast("double").alias("valor"))
    t = t.join(nodes, "PAC_1", "left_semi").join(fed.select(F.col("node").alias("PAC_1"), F.col("fed_by").alias("fonte")), "PAC_1", "left")
    if customers is not None:
        t = transformer_attributes(t, customers).withColumnRenamed("N_UCBT", "n_UCBT")
    else:
        t = t.withColumn("n_UCBT", F.lit(0).cast("long"))
    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    t = t.select(
        F.lit("UNTRMT").alias("camada"), "COD_ID", "CTMT", "PAC_1", text.alias("PAC_2"), text.alias("normal"), flag.alias("aberta"), flag.alias("TLCD"),
        flag.alias("tie"), F.lit(False).alias("externa"), F.col("fonte").isNotNull().alias("energizado"), "fonte", "valor", "n_UCBT",
    )
    return state.select(*columns).unionByName(t)
