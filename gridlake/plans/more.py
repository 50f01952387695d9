"""Remaining operators on the driver's tables: selections, cleaning, map attributes, loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators import impact, load, results
from gridlake.operators import network as net
from gridlake.operators import restoration as rst
from gridlake.plans.grid import _EDGES, _FED, _LOST, _NETWORK, _OPTIONS, _ZONES, grid, layers, options, with_grid, zones
from gridlake.plans.registry import query, table
from gridlake.session import materialise
from gridlake.sources.logs import log_tail
from gridlake.sources.register import REGISTER_COLUMNS, normalise_register
from gridlake.sources.sinks import segment_attributes, switch_attributes, transformer_attributes


@query(
    "tie_switches",
    with_grid(
        _EDGES
        + "SELECT split_part(e.id, '|', 1) AS chave, e.ctmt, split_part(e.id, '|', 2) AS ctmt_viz, e.u AS pac, e.v AS pac_viz, b.open AS aberta FROM edge e JOIN base b ON b.id = split_part(e.id, '|', 1) WHERE e.kind = 'tie'",
        *_NETWORK[:4],
    ),
)
def tie_switches(spark: SparkSession, sf: str) -> DataFrame:
    """N19."""
    return net.tie_switches(grid(spark, sf)["edges"]).select("chave", "ctmt", "ctmt_viz", "pac", "pac_viz", "aberta")


@query(
    "connected_nodes",
    with_grid(
        """
  p AS (SELECT PAC_1 AS a, PAC_2 AS b FROM ssdmt UNION ALL SELECT PAC_1, PAC_2 FROM unsemt), w AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  r(n, f) AS (SELECT PAC_INI, COD_ID FROM ctmt UNION SELECT w.b, r.f FROM r JOIN w ON w.a = r.n)
SELECT n AS node, min(f) AS ctmt, true AS connected FROM r WHERE n IN (SELECT a FROM w) GROUP BY 1
""",
        "CTMT", "SSDMT", "UNSEMT",
    ),
)
def connected_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every switch counts as closed."""
    lay = layers(spark, sf)
    return net.connected_to_source([lay["SSDMT"], lay["UNSEMT"]], lay["CTMT"])


@query(
    "voltage_profile",
    with_grid(
        _EDGES + "," + _FED + "," + _ZONES + "," + _LOST + "," + _OPTIONS
        + """,
  eb AS MATERIALIZED (SELECT e.id, e.kind, e.open, e.gate, e.comp, e.u AS a, e.v AS b FROM edge e UNION ALL SELECT e.id, e.kind, e.open, e.gate, e.comp, e.v, e.u FROM edge e),
  vp AS (SELECT concat('N', o_custkey) AS n, min(1.05 - l_discount) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
  wk(zone, chave, n, d, path) AS (
    SELECT o.zone, o.chave, s.n, 0.0::DOUBLE, [s.n] FROM opt o JOIN src s ON s.f = o.fonte
    UNION ALL SELECT w.zone, w.chave, e.b, w.d + e.comp, list_append(w.path, e.b) FROM wk w JOIN eb e ON e.a = w.n JOIN zone za ON za.n = e.a JOIN zone zb ON zb.n = e.b
    WHERE za.z <> w.zone AND zb.z <> w.zone AND NOT list_contains(w.path, e.b)
      AND (e.kind <> 'chave' OR e.id = w.chave OR (NOT e.open AND NOT EXISTS (SELECT 1 FROM bound x WHERE x.z = w.zone AND x.gate = e.id)))),
  rec AS (SELECT DISTINCT t.z AS zone, t.gate AS chave, zone.n FROM touched t JOIN piece p ON p.z = t.z AND p.p = t.p JOIN zone ON zone.z = p.v),
  far AS (SELECT *, row_number() OVER (PARTITION BY zone, chave ORDER BY d DESC, n DESC) AS r FROM wk JOIN rec USING (zone, chave, n)),
  st AS (SELECT zone, chave, d, len(path) AS nos, unnest(path) AS n FROM far WHERE r = 1)
SELECT zone, chave, any_value(nos) AS nos, any_value(round_even(d * 10, 0) / 10) AS metros, min(vp.v) AS v_min FROM st LEFT JOIN vp USING (n) GROUP BY 1, 2
""",
        *_NETWORK,
    ),
)
def voltage_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Every option of every zone; nodes, length and lowest voltage of its longest path."""
    g = grid(spark, sf)
    graph, iso = zones(spark, sf)
    volts = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("barra"), (1.05 - F.col("l_discount")).alias("v_pu")
    )
    path = rst.voltage_profile(graph, iso, g["edges"], g["sources"], options(spark, sf), volts)
    return path.groupBy("zone", "chave").agg(F.count(F.lit(1)).alias("nos"), F.max("distancia_m").alias("metros"), F.min("v_pu").alias("v_min"))


@query(
    "high_penetration",
    """SELECT s_suppkey AS ctmt, abs(s_acctbal) + s_nationkey AS potencia_total_kw FROM supplier WHERE s_nationkey < 10 ORDER BY 2 DESC, abs(s_acctbal) DESC, 1 LIMIT 5""",
)
def high_penetration(spark: SparkSession, sf: str) -> DataFrame:
    """T6."""
    rows = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS ctmt", "abs(s_acctbal) AS potencia_exata_kw", "CAST(s_nationkey AS DOUBLE) AS potencia_agregada_kw", "IF(s_nationkey < 10, 'alta Penetração', 'sorteio') AS origem"
    )
    return results.high_penetration(rows, 5).select("ctmt", "potencia_total_kw")


@query("eligible_cases", "SELECT event_id AS ordem_sorteio, user_id AS ctmt FROM events WHERE event_type = 'view' AND value < 100 ORDER BY 1, 2 LIMIT 10")
def eligible_cases(spark: SparkSession, sf: str) -> DataFrame:
    """T7."""
    rows = table(spark, sf, "events").selectExpr(
        "event_id AS ordem_sorteio", "user_id AS ctmt", "IF(event_type = 'view', 'restore_options', event_type) AS etapa", "IF(value < 100, 'sucesso', 'falha') AS status"
    )
    return results.eligible_cases(rows, 10).select("ordem_sorteio", "ctmt")


@query("log_tail", "SELECT event_id AS seq, event_type AS tipo FROM events ORDER BY 1 DESC LIMIT 25")
def log_tail_query(spark: SparkSession, sf: str) -> DataFrame:
    """T8."""
    return log_tail(table(spark, sf, "events").selectExpr("event_id AS seq", "event_type AS tipo"), 25)


@query(
    "viable_options",
    "SELECT p_partkey AS id FROM part WHERE p_size > 25 AND p_brand <> 'Brand#11' AND p_type <> 'ECONOMY' AND p_name <> 'red widget'",
)
def viable_options(spark: SparkSession, sf: str) -> DataFrame:
    """P11."""
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("chave"), (F.col("p_size") > 25).alias("viavel"),
        F.when(F.col("p_brand") == "Brand#11", F.lit("regra")).alias("bloqueio"), F.array("p_type").alias("switches"),
    )
    return impact.viable_options(rows, ["ECONOMY", "red widget"]).select("id")


@query(
    "register_clean",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, o_custkey FROM orders WHERE o_orderstatus <> 'P')
    SELECT CAST(o_orderkey AS VARCHAR) AS cod_empreendimento, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END AS potencia_kw, CAST(year(o_orderdate) AS INTEGER) AS ano_conexao,
      CASE WHEN o_orderstatus = 'F' THEN concat('UFV — ', o_orderpriority) ELSE o_orderpriority END AS fonte_normalizada,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'não informada' ELSE concat(o_orderpriority, ' (', o_orderstatus, ')') END AS classe_normalizada, 'sem subgrupo' AS subgrupo_normalizado FROM r""",
)
def register_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Raw register text from orders, cleaned and filtered to one utility."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    low = F.col("o_orderpriority") == "5-LOW"
    filled = {
        "NumCNPJDistribuidora": F.lit(" 1 "), "SigUF": F.lit("RJ"), "NomAgente": F.when(F.col("o_orderstatus") == "P", "X").otherwise("U "), "CodEmpreendimento": F.concat(F.lit(" "), key),
        "MdaPotenciaInstaladaKW": F.when(F.col("o_custkey") % 3 == 0, "n/d").otherwise(F.col("o_totalprice").cast("string")),
        "DthAtualizaCadastralEmpreend": F.date_format("o_orderdate", "yyyy-MM-dd"), "SigTipoGeracao": F.when(F.col("o_orderstatus") == "F", "UFV").otherwise(" "),
        "DscFonteGeracao": F.col("o_orderpriority"), "DscClasseConsumo": F.when(low, F.lit(None)).otherwise(F.col("o_orderpriority")), "CodClasseConsumo": F.when(low, " ").otherwise(F.col("o_orderstatus")),
    }
    raw = o.select(*[filled.get(c, F.lit(None).cast("string")).alias(c) for c in REGISTER_COLUMNS])
    return normalise_register(raw, tax_id="1", state="RJ", agent="U").select(
        "cod_empreendimento", "potencia_kw", "ano_conexao", "fonte_normalizada", "classe_normalizada", "subgrupo_normalizado"
    )


@query(
    "map_switches",
    with_grid(
        """
  t AS (SELECT COD_ID, arg_min(CTMT_VIZ, (DIST_M, CTMT_VIZ)) AS viz, arg_min(EM_SUB, (DIST_M, CTMT_VIZ)) AS em FROM interligacoes GROUP BY 1)
SELECT s.COD_ID, CASE TIP_UNID WHEN '29' THEN 'disjuntor' WHEN '22' THEN 'chave fusível' ELSE 'chave faca' END AS "TIPO", t.viz IS NOT NULL AS "TIE", t.viz AS CTMT_VIZ, t.em AS EM_SUB FROM unsemt s LEFT JOIN t ON t.COD_ID = s.COD_ID
""",
        "UNSEMT", "INTERLIGACOES", recursive=False,
    ),
)
def map_switches(spark: SparkSession, sf: str) -> DataFrame:
    """P8."""
    lay = layers(spark, sf)
    return switch_attributes(lay["UNSEMT"], lay["INTERLIGACOES"]).select("COD_ID", "TIPO", "TIE", "CTMT_VIZ", "EM_SUB")


@query(
    "map_segments",
    with_grid(
        'SELECT s.COD_ID, CAST(CASE f.TEN_NOM WHEN \'46\' THEN 13.2 ELSE 13.8 END AS DOUBLE) AS "TEN_KV", f.NOME AS "NOME_CTMT" FROM ssdmt s JOIN ctmt f ON f.COD_ID = s.CTMT', "CTMT", "SSDMT", recursive=False
    ),
)
def map_segments(spark: SparkSession, sf: str) -> DataFrame:
    """P8."""
    lay = layers(spark, sf)
    return segment_attributes(lay["SSDMT"], lay["CTMT"]).select("COD_ID", "TEN_KV", "NOME_CTMT")


@query(
    "map_transformers",
    with_grid("SELECT t.COD_ID, count(u.COD_ID) AS \"N_UCBT\" FROM untrmt t LEFT JOIN ucbt_tab u ON u.UNI_TR_MT = t.COD_ID GROUP BY 1", "UNTRMT", "UCBT_tab", recursive=False),
)
def map_transformers(spark: SparkSession, sf: str) -> DataFrame:
    """P8."""
    lay = layers(spark, sf)
    return transformer_attributes(lay["UNTRMT"], lay["UCBT_tab"]).select("COD_ID", "N_UCBT")


@query(
    "load_table",
    """WITH r AS (SELECT concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS id, l_partkey AS ramal, l_quantity AS q, l_linenumber AS k, l_returnflag AS f, l_linestatus AS s FROM lineitem),
      n AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY ramal) > 1 THEN concat(ramal, '_', row_number() OVER (PARTITION BY ramal ORDER BY id)) ELSE CAST(ramal AS VARCHAR) END AS nome FROM r),
      w AS (SELECT *, floor(q * CASE f WHEN 'A' THEN 0.002::DOUBLE WHEN 'N' THEN 0.003::DOUBLE ELSE 0.001::DOUBLE END * 1000000.0::DOUBLE) / 1000000.0::DOUBLE AS kw FROM n)
    SELECT concat('MT_', nome) AS carga, CASE WHEN s = 'F' THEN 'AN' ELSE 'ABC' END AS fas_con, CAST(CASE WHEN s = 'F' THEN 1 ELSE 3 END AS INTEGER) AS fases, CASE WHEN s = 'F' THEN 'Wye' ELSE 'Delta' END AS conexao,
      kw AS kw_curva, CASE WHEN k > 3 THEN CAST(k AS DOUBLE) ELSE kw END AS kw_nominal FROM w""",
)
def load_table(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as medium-voltage customers."""
    rows = table(spark, sf, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS COD_ID", "CAST(l_partkey AS STRING) AS PN_CON", "'x' AS PAC", "l_quantity AS ENE_01",
        "IF(l_linestatus = 'F', 'AN', '') AS FAS_CON", "l_returnflag AS TIP_CC", "IF(l_linenumber > 3, CAST(l_linenumber AS DOUBLE), 0.0D) AS CAR_INST",
    )
    flags = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("COD_ID")).distinct().where("COD_ID IN ('A', 'N')")
    factors = flags.select("COD_ID", F.when(F.col("COD_ID") == "A", 0.002).otherwise(0.003).alias("fator")).unionByName(
        flags.limit(1).select(F.lit("").alias("COD_ID"), F.lit(0.001).alias("fator"))
    )
    out = load.load_table(rows, factors, 1, None, low_voltage=False)
    return out.select("carga", "fas_con", "fases", "conexao", "kw_curva", "kw_nominal")


@query(
    "source_fallback",
    """WITH e AS (SELECT l_suppkey AS f, l_partkey AS p FROM lineitem) SELECT CAST(s_suppkey AS VARCHAR) AS ctmt, CASE WHEN s_acctbal > 0 THEN concat('r', s_suppkey) ELSE min(concat('n', p)) END AS node, s_acctbal <= 0 AS fallback
    FROM supplier JOIN e ON f = s_suppkey GROUP BY s_suppkey, s_acctbal""",
)
def source_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Feeders with a poor balance declare a node that is not in the network."""
    lines = table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    segments = lines.select(key.alias("COD_ID"), F.col("l_suppkey").cast("string").alias("CTMT"), F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("PAC_1"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("PAC_2"))
    edges = materialise(net.build_edges(segments, segments.where(F.lit(False))), "star")
    feeders = table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS COD_ID", "IF(s_acctbal > 0, concat('r', s_suppkey), 'fora') AS PAC_INI")
    return net.feeder_sources(feeders, edges)
