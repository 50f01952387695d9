"""Sources, sinks and small table operators: what is written is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.columns import join_codes, round_record, split_codes
from gridlake.operators import clip
from gridlake.operators.recon import feeder_region_cascade
from gridlake.plans.geometry import _place, shaped_layers
from gridlake.plans.grid import layers, with_grid
from gridlake.plans.registry import ORACLES, query, table
from gridlake.session import app_scratch
from gridlake.sources.catalog import LayerCatalog, export_layers
from gridlake.sources.register import asset_generators
from gridlake.sources.runs import read_runs, read_table
from gridlake.sources.sinks import write_table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{app_scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query("layer_scan", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def layer_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A layer found whatever its case, absent columns ignored, a pushed IN list; an empty list adds no row."""
    catalog = LayerCatalog(spark, sf)
    (layer,), _ = catalog.resolve(["CUSTOMER", " customer "])
    wanted = ["c_custkey", "c_nationkey", "absent"]
    found = catalog.read_in(layer, "c_mktsegment", ["BUILDING", "MACHINERY"], wanted)
    return found.unionByName(catalog.read_in(layer, "c_mktsegment", [], wanted))


def _bounds(alias: str) -> str:
    return ", ".join(f"{how}({f}({a}, {b})) AS {n}" for n, how, f, a, b in (
        ("minx", "min", "least", f"{alias}.x1", f"{alias}.x2"), ("miny", "min", "least", f"{alias}.y1", f"{alias}.y2"),
        ("maxx", "max", "greatest", f"{alias}.x1", f"{alias}.x2"), ("maxy", "max", "greatest", f"{alias}.y1", f"{alias}.y2")))


@query(
    "layer_export",
    with_grid(
        f"""
  p AS ({_place("SSDMT")})
SELECT 'SSDMT' AS layer, (SELECT count(*) FROM ssdmt) AS rows, {_bounds("p")}, 'MultiLineString' AS kinds, (SELECT count(*) FROM ssdmt) AS lidos FROM p
UNION ALL SELECT 'UNTRMT', count(*), NULL, NULL, NULL, NULL, '', count(*) FROM untrmt
UNION ALL SELECT 'EMPTY', 0, NULL, NULL, NULL, NULL, '', 0
""",
        "SSDMT", "UNTRMT", recursive=False,
    ),
)
def layer_export(spark: SparkSession, sf: str) -> DataFrame:
    """Layers written with their manifest, a geometry column renamed, then read back and counted."""
    lay = shaped_layers(spark, sf)
    frames = {"SSDMT": lay["SSDMT"].withColumnRenamed("geometry", "wkb"), "UNTRMT": lay["UNTRMT"], "EMPTY": lay["UNTRMT"].where(F.lit(False))}
    folder = _folder(spark, "export")
    manifest = export_layers(LayerCatalog.of(spark, frames), folder, ["ssdmt", "Untrmt", "UNTRMT", "empty"], {"SSDMT": "wkb"})
    written = LayerCatalog(spark, folder)
    counts = [written.read(n).agg(F.lit(n).alias("layer"), F.count(F.lit(1)).alias("lidos")) for n in frames]
    return manifest.join(counts[0].unionByName(counts[1]).unionByName(counts[2]), "layer")


@query("clip_sink", f"SELECT clip_id, layer, n, n AS gravadas FROM ({ORACLES['clip_chain']})")
def clip_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Every clip written per layer with its manifest; the manifest's counts beside those of what is read back."""
    lay = layers(spark, sf)
    feeders = lay["CTMT"]
    bridge = feeders.select(F.col("COD_ID").alias("clip_id"), F.col("COD_ID").alias("ctmt")).unionByName(
        feeders.select(F.col("SUB").alias("clip_id"), F.col("COD_ID").alias("ctmt")))
    selected = clip.select_layers(LayerCatalog.of(spark, {k: v for k, v in lay.items() if k != "INTERLIGACOES"}), bridge, ties=lay["INTERLIGACOES"])
    folder = _folder(spark, "clips")
    clip.write_clips(selected, bridge, folder)
    listed = spark.read.json(f"{folder}/_manifest", schema="clip_id string, layers map<string,bigint>").select("clip_id", F.explode("layers").alias("layer", "n"))
    back = None
    for layer in selected:
        rows = spark.read.parquet(f"{folder}/{layer}").groupBy(F.col("clip_id").cast("string").alias("clip_id")).agg(F.count(F.lit(1)).alias("gravadas")).withColumn("layer", F.lit(layer))
        back = rows if back is None else back.unionByName(rows)
    return listed.join(back, ["clip_id", "layer"], "left").select("clip_id", "layer", "n", F.coalesce("gravadas", F.lit(0)).alias("gravadas"))


@query("csv_table", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def csv_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table as CSV and back, all text."""
    folder = _folder(spark, "csv")
    write_table(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), folder)
    return read_table(spark, folder)


@query(
    "run_table",
    """SELECT o_orderpriority AS tarefa, o_orderstatus AS nivel, o_orderkey AS repeticao, o_orderstatus = 'F' AS acerto, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS tokens_prompt,
      CAST(0 AS BIGINT) AS tokens_total, '?' AS provider, true AS exemplos, CAST(NULL AS VARCHAR) AS erro FROM orders WHERE o_orderstatus <> 'P'""",
)
def run_table(spark: SparkSession, sf: str) -> DataFrame:
    """Typed runs from CSV, defaults for absent columns and blank cells, rows without a level dropped."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("tarefa"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("nivel"), F.col("o_orderkey").alias("repeticao"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("acerto"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("tokens_prompt"))
    folder = _folder(spark, "runs")
    write_table(rows, folder)
    return read_runs(spark, folder).select("tarefa", "nivel", "repeticao", "acerto", "tokens_prompt", "tokens_total", "provider", "exemplos", "erro")


@query(
    "base_metadata",
    """SELECT CAST(o_custkey AS INTEGER) AS DIST, CAST(o_orderkey % 7 AS VARCHAR) AS DAT_INC, o_orderstatus AS DAT_FNL, o_orderpriority AS DAT_EXT, trim(o_orderpriority) AS DESCR FROM orders
    ORDER BY o_orderpriority DESC, o_orderstatus DESC, CAST(o_orderkey % 7 AS VARCHAR) DESC, CAST(o_custkey AS VARCHAR), o_orderpriority LIMIT 1""",
)
def base_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Of many rows the newest, with a stated order."""
    base = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("DIST"), (F.col("o_orderkey") % 7).alias("DAT_INC"), F.col("o_orderstatus").alias("DAT_FNL"), F.col("o_orderpriority").alias("DAT_EXT"),
        F.col("o_orderpriority").alias("DESCR"))
    return LayerCatalog.of(spark, {"BASE": base}).base_metadata()


@query("rounded_record", "SELECT o_orderkey, round_even(o_totalprice / 7, 2) AS preco, o_orderstatus FROM orders")
def rounded_record(spark: SparkSession, sf: str) -> DataFrame:
    """P13."""
    return round_record(table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 7).alias("preco"), "o_orderstatus"), 2)


@query(
    "code_lists",
    """SELECT o_orderkey, array_to_string(list_filter(list_transform(string_split(concat(' ', o_custkey, ' ;;', o_orderstatus, '; ', o_orderpriority, ' ;'), ';'), lambda x: trim(x)), lambda x: x <> ''), ';') AS codigos FROM orders""",
)
def code_lists(spark: SparkSession, sf: str) -> DataFrame:
    """F9."""
    text = F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ;;"), "o_orderstatus", F.lit("; "), "o_orderpriority", F.lit(" ;"))
    return table(spark, sf, "orders").select("o_orderkey", join_codes(split_codes(text)).alias("codigos"))


_OWN_REGION = "CASE WHEN CAST(substr(COD_ID, 2) AS BIGINT) % 3 = 0 THEN concat(CAST(substr(COD_ID, 2) AS BIGINT) % 30, ';', CAST(substr(COD_ID, 2) AS BIGINT) % 7) ELSE '' END"


@query(
    "region_cascade",
    with_grid(
        f"""
  own AS (SELECT COD_ID, {_OWN_REGION} AS o FROM ctmt),
  every AS (SELECT CTMT, CONJ FROM ucbt_tab UNION ALL SELECT CTMT, CONJ FROM ucmt_tab UNION ALL SELECT CTMT, CONJ FROM untrmt),
  md AS (SELECT CTMT, CONJ FROM (SELECT CTMT, CONJ, row_number() OVER (PARTITION BY CTMT ORDER BY count(*) DESC, CONJ) AS r FROM every GROUP BY 1, 2) WHERE r = 1),
  cd AS (SELECT own.COD_ID, CASE WHEN o <> '' THEN o ELSE coalesce(md.CONJ, '') END AS c FROM own LEFT JOIN md ON md.CTMT = own.COD_ID),
  pt AS (SELECT COD_ID, c, unnest(string_split(c, ';')) AS k, generate_subscripts(string_split(c, ';'), 1) AS i FROM cd),
  nm AS (SELECT COD_ID, c, string_agg(n.n_name, ';' ORDER BY i) AS n FROM pt LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = k GROUP BY 1, 2)
SELECT COD_ID, c AS CONJ_CODIGO, coalesce(n, c) AS CONJ_NOME FROM nm
""",
        "CTMT", "UCBT_tab", "UCMT_tab", "UNTRMT", recursive=False,
    ),
)
def region_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Own code list, else the commonest of the feeder's customers and transformers; names part by part."""
    lay = layers(spark, sf)
    frames = {
        "CTMT": lay["CTMT"].withColumn("CONJ", F.expr(_OWN_REGION)), **{n: lay[n] for n in ("UCBT_tab", "UCMT_tab", "UNTRMT")},
        "CONJ": table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("COD_ID"), F.col("n_name").alias("NOME")),
    }
    return feeder_region_cascade(LayerCatalog.of(spark, frames))


@query(
    "asset_generators",
    with_grid(
        """
  g AS (SELECT COD_ID, CTMT, UNI_TR_MT, POT_INST, 'UGBT_tab' AS l FROM ugbt_tab UNION ALL SELECT COD_ID, CTMT, UNI_TR_MT, POT_INST, 'UGBT_tab' FROM ugbt_tab WHERE POT_INST > 200
        UNION ALL SELECT COD_ID, CTMT, NULL, POT_INST, 'UGMT_tab' FROM ugmt_tab UNION ALL SELECT COD_ID, CTMT, NULL, POT_INST, 'UGMT_tab' FROM ugbt_tab WHERE POT_INST > 300)
SELECT COD_ID AS cod_id_base, CTMT AS ctmt, min(l) AS camada_origem, coalesce(max(UNI_TR_MT), '') AS uni_tr_mt, any_value(POT_INST) AS potencia_kw_base, count(*) AS linhas_origem_duplicadas FROM g GROUP BY 1, 2
""",
        "UGBT_tab", "UGMT_tab", recursive=False,
    ),
)
def asset_generators_query(spark: SparkSession, sf: str) -> DataFrame:
    """Two layers with different columns in one shape, copies inside and across layers counted once."""
    lay = layers(spark, sf)
    low, high = lay["UGBT_tab"], lay["UGMT_tab"]
    frames = {"UGBT_tab": low.unionByName(low.where("POT_INST > 200")), "UGMT_tab": high.unionByName(low.where("POT_INST > 300").drop("UNI_TR_MT"))}
    return asset_generators(LayerCatalog.of(spark, frames)).select("cod_id_base", "ctmt", "camada_origem", "uni_tr_mt", "potencia_kw_base", "linhas_origem_duplicadas")


@query("clip_union", with_grid("SELECT COD_ID, CTMT, PAC_1, PAC_2, COMP FROM ssdmt", "SSDMT", recursive=False))
def clip_union(spark: SparkSession, sf: str) -> DataFrame:
    """The segments of all feeder clips and all substation clips, each once."""
    lay = layers(spark, sf)
    own = lay["SSDMT"].withColumn("clip_id", F.col("CTMT"))
    by_station = lay["SSDMT"].join(lay["CTMT"].select(F.col("COD_ID").alias("CTMT"), F.col("SUB").alias("clip_id")), "CTMT").drop("CONJ", "FAS_CON")
    return clip.union_clips([own, by_station]).select("COD_ID", "CTMT", "PAC_1", "PAC_2", "COMP")

