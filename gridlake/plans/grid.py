"""Network operators on a distribution grid that SQL derives from the driver's tables.

Fifty customers make a feeder: a breaker, then a binary tree whose edges are segments or closed
switches by market segment. Urgent pending orders are normally-open switches between the customers
of consecutive orders: a ring inside one feeder, a tie between two. Order lines are the low-voltage
customers of their order's customer, finished orders its medium-voltage customers. The grid grows
with the tables; the same statements define it for Spark and for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators import atlas, clip, impact
from gridlake.operators import network as net
from gridlake.operators import restoration as rst
from gridlake.operators.inventory import feeder_inventory, top_feeders
from gridlake.operators.ties import both_directions
from gridlake.plans.registry import ORACLES, query, table
from gridlake.session import materialise
from gridlake.sources.catalog import LayerCatalog
from gridlake.sources.sinks import network_state

_CUSTOMER = """SELECT c_custkey AS c, CAST(floor(c_custkey / 50) AS BIGINT) AS f, c_custkey % 50 AS i, c_mktsegment AS seg,
    c_acctbal AS bal, c_nationkey AS nat,
    CAST(floor(c_custkey / 50) AS BIGINT) * 50 + CASE WHEN c_custkey % 50 = 1 THEN 0 ELSE 1 + CAST(floor((c_custkey % 50 - 2) / 2) AS BIGINT) END AS parent
    FROM {customer}"""
_OPEN = """SELECT a.o_orderkey AS o, a.o_custkey AS ca, b.o_custkey AS cb, CAST(floor(a.o_custkey / 50) AS BIGINT) AS fa,
    CAST(floor(b.o_custkey / 50) AS BIGINT) AS fb, a.o_totalprice AS price
    FROM {orders} a JOIN {orders} b ON b.o_orderkey = a.o_orderkey + 1
    WHERE a.o_orderstatus = 'P' AND a.o_orderpriority = '1-URGENT'"""
# layer -> statement; {cust} and {opens} are the two statements above
GRID = {
    "CTMT": """SELECT concat('F', f) AS COD_ID, concat(min(seg), ' ', f) AS NOME, concat('S', CAST(floor(f / 10) AS BIGINT)) AS SUB,
        concat('A', f) AS UNI_TR_AT, CASE WHEN f % 2 = 0 THEN '46' ELSE '49' END AS TEN_NOM, concat('N', f * 50) AS PAC_INI,
        CAST(min(nat) * 1000 AS DOUBLE) AS ENE_01, '' AS CONJ FROM {cust} GROUP BY f""",
    "SUB": """SELECT concat('S', CAST(floor(f / 10) AS BIGINT)) AS COD_ID, min(seg) AS NOME FROM {cust} GROUP BY 1""",
    "SSDMT": """SELECT concat('L', c) AS COD_ID, concat('F', f) AS CTMT, concat('N', parent) AS PAC_1, concat('N', c) AS PAC_2,
        abs(bal) AS COMP, concat('C', nat) AS TIP_CND, concat('', nat) AS CONJ, CASE WHEN nat < 12 THEN 'ABC' ELSE 'AN' END AS FAS_CON
        FROM {cust} WHERE i > 1 AND seg NOT IN ('MACHINERY', 'HOUSEHOLD')""",
    "UNSEMT": """SELECT concat('K', c) AS COD_ID, concat('F', f) AS CTMT, concat('N', parent) AS PAC_1, concat('N', c) AS PAC_2, 'F' AS P_N_OPE,
        CASE WHEN i = 1 OR seg = 'MACHINERY' THEN 1 ELSE 0 END AS TLCD, CASE WHEN i = 1 THEN '29' ELSE '22' END AS TIP_UNID, concat('', nat) AS MUN, concat('', nat) AS CONJ
        FROM {cust} WHERE i = 1 OR (i > 1 AND seg IN ('MACHINERY', 'HOUSEHOLD'))
        UNION ALL SELECT concat(CASE WHEN fa = fb THEN 'R' ELSE 'T' END, o), concat('F', fa), concat('N', ca), CASE WHEN fa = fb THEN concat('N', cb) ELSE concat('X', o) END,
        'A', CASE WHEN price > 250000 THEN 1 ELSE 0 END, '19', concat('', fb % 25), concat('', fb % 25) FROM {opens}""",
    "INTERLIGACOES": """SELECT concat('T', o) AS COD_ID, concat('F', fa) AS CTMT, concat('F', fb) AS CTMT_VIZ, concat('L', cb) AS SSDMT_VIZ, concat('N', cb) AS PAC_VIZ,
        price / 1000000 AS DIST_M, 'A' AS P_N_OPE, CASE WHEN price > 250000 THEN 1 ELSE 0 END AS TLCD, '19' AS TIP_UNID, price > 450000 AS EM_SUB
        FROM {opens} WHERE fa <> fb""",
    "UNTRMT": """SELECT concat('TR', c) AS COD_ID, concat('F', f) AS CTMT, concat('N', c) AS PAC_1, abs(bal) AS POT_NOM, concat('', nat) AS MUN, concat('', nat) AS CONJ FROM {cust}""",
    "UCBT_tab": """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS COD_ID, concat('TR', o_custkey) AS UNI_TR_MT,
        concat('F', l_suppkey) AS CTMT, l_quantity AS ENE_01, l_quantity AS CAR_INST, concat('', l_suppkey % 25) AS CONJ, l_returnflag AS TIP_CC,
        concat('P', l_partkey) AS PN_CON FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey""",
    "UCMT_tab": """SELECT concat('M', o_orderkey) AS COD_ID, concat('N', o_custkey) AS PAC, concat('F', CAST(floor(o_custkey / 50) AS BIGINT)) AS CTMT,
        o_totalprice AS ENE_01, concat('', o_custkey % 25) AS CONJ FROM {orders} WHERE o_orderstatus = 'F'""",
    "UGBT_tab": """SELECT concat('G', o_orderkey) AS COD_ID, concat('TR', o_custkey) AS UNI_TR_MT, 'F0' AS CTMT, o_totalprice / 1000 AS POT_INST
        FROM {orders} WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'""",
    "UGMT_tab": """SELECT concat('H', o_orderkey) AS COD_ID, concat('F', CAST(floor(o_custkey / 50) AS BIGINT)) AS CTMT, o_totalprice / 1000 AS POT_INST
        FROM {orders} WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW'""",
    "SEGCON": """SELECT concat('C', n_nationkey) AS COD_ID FROM {nation}""",
    "CRVCRG": """SELECT DISTINCT l_returnflag AS COD_ID FROM {lineitem}""",
    "PONNOT": """SELECT concat('P', p_partkey) AS COD_ID FROM {part}""",
}
_STATE: dict[tuple, object] = {}


def _statement(name: str) -> str:
    return GRID[name].replace("{cust}", f"({_CUSTOMER}) cu").replace("{opens}", f"({_OPEN}) op")


def _plain(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", _statement(name))


def once(spark: SparkSession, sf: str, name: str, build):
    """Written intermediate of one session and data folder, shared by the queries."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STATE:
        _STATE[key] = build()
    return _STATE[key]


def forget() -> None:
    """Drop the shared intermediates, e.g. after the inputs or the scratch folder have changed."""
    _STATE.clear()


def layers(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    tables = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem", "part", "nation")}

    def run(name: str) -> DataFrame:
        text = _statement(name)
        used = {n: df for n, df in tables.items() if f"{{{n}}}" in text}
        return spark.sql(text, **used)

    return {name: run(name) for name in GRID}


class Parts(dict):
    """Layers plus written intermediates, each made when it is first asked for."""

    def __init__(self, made: dict, makers: dict):
        super().__init__(made)
        self.makers = makers

    def __missing__(self, name: str):
        self[name] = self.makers[name](self)
        return self[name]


def grid(spark: SparkSession, sf: str) -> Parts:
    """Layers plus the written edges, sources, node customers and zones."""

    def edges(g: Parts) -> DataFrame:
        return materialise(net.add_ties(net.build_edges(g["SSDMT"], g["UNSEMT"]), g["INTERLIGACOES"], g["CTMT"]), "grid-edges")

    makers = {
        "edges": edges,
        "sources": lambda g: materialise(net.feeder_sources(g["CTMT"], g["edges"]), "grid-sources"),
        "customers": lambda g: materialise(net.customers_per_node(g["edges"], g["UNTRMT"], g["UCBT_tab"], g["UCMT_tab"]), "grid-customers"),
        "labels": lambda g: rst.zone_labels(g["edges"]),
        "graph": lambda g: rst.zone_graph(g["edges"], g["sources"], g["customers"], g["labels"]),
        "isolation": lambda g: rst.isolate_zones(g["graph"]),
        "located": lambda g: rst.lost_ends(g["graph"], g["isolation"]),
    }
    return once(spark, sf, "grid", lambda: Parts(layers(spark, sf), makers))


def zones(spark: SparkSession, sf: str) -> tuple[rst.ZoneGraph, rst.Isolation]:
    g = grid(spark, sf)
    return g["graph"], g["isolation"]


def options(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "options", lambda: materialise(rst.restoration_options(*zones(spark, sf), grid(spark, sf)["located"]), "grid-options"))


def fed(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    return once(spark, sf, "fed", lambda: materialise(net.energised(g["edges"], g["sources"]), "grid-fed"))


# --- oracle building blocks ----------------------------------------------------------------------


def with_grid(body: str, *names: str, recursive: bool = True) -> str:
    """``body`` after the grid CTEs it names."""
    ctes = ",\n".join(f"{n.lower()} AS MATERIALIZED ({_plain(n)})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{',' if ctes and not body.lstrip().upper().startswith('SELECT') else ''}\n{body}"


_EDGES = """
  raw AS (SELECT 0 AS p, COD_ID AS id, 'trecho' AS kind, PAC_1 AS u, PAC_2 AS v, CTMT AS ctmt, COMP AS comp, false AS open, 0 AS tlcd, CAST(NULL AS VARCHAR) AS gate FROM ssdmt
          UNION ALL SELECT 1, COD_ID, 'chave', PAC_1, PAC_2, CTMT, 0.0, P_N_OPE = 'A', TLCD, COD_ID FROM unsemt),
  base AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY p, id, u) AS r FROM raw WHERE u <> v) WHERE r = 1),
  tie AS (SELECT t.COD_ID, t.CTMT, t.CTMT_VIZ, t.TLCD, t.DIST_M, b.v AS pac, t.PAC_VIZ AS viz,
                 row_number() OVER (PARTITION BY least(b.v, t.PAC_VIZ), greatest(b.v, t.PAC_VIZ) ORDER BY t.DIST_M, t.COD_ID) AS r
          FROM interligacoes t JOIN base b ON b.id = t.COD_ID WHERE NOT t.EM_SUB),
  vizn AS (SELECT u AS n FROM base UNION SELECT v FROM base),
  edge AS MATERIALIZED (SELECT id, kind, u, v, ctmt, comp, open, tlcd, gate FROM base
           UNION ALL SELECT COD_ID || '|' || CTMT_VIZ, 'tie', pac, viz, CTMT, 0.0, false, TLCD, NULL FROM tie JOIN vizn ON n = viz WHERE r = 1),
  node AS (SELECT u AS n FROM edge UNION SELECT v FROM edge),
  both_ AS MATERIALIZED (SELECT id, kind, u AS a, v AS b, open, gate FROM edge UNION ALL SELECT id, kind, v, u, open, gate FROM edge),
  src AS (SELECT COD_ID AS f, PAC_INI AS n FROM ctmt JOIN node ON n = PAC_INI)
"""
_FED = """
  fed(n, f) AS (SELECT n, f FROM src UNION SELECT b.b, fed.f FROM fed JOIN both_ b ON b.a = fed.n AND NOT b.open)
"""
_ZONES = """
  zr(s, n) AS (SELECT n, n FROM node UNION SELECT zr.s, b.b FROM zr JOIN both_ b ON b.a = zr.n AND b.gate IS NULL),
  zone AS MATERIALIZED (SELECT s AS n, min(n) AS z FROM zr GROUP BY 1),
  zedge AS MATERIALIZED (SELECT e.id, e.gate, e.kind, e.open, e.tlcd, e.ctmt, zu.z AS a, zv.z AS b FROM edge e JOIN zone zu ON zu.n = e.u JOIN zone zv ON zv.n = e.v
            WHERE e.gate IS NOT NULL AND zu.z <> zv.z),
  zboth AS MATERIALIZED (SELECT gate, open, tlcd, ctmt, a, b, 0 AS side FROM zedge UNION ALL SELECT gate, open, tlcd, ctmt, b, a, 1 FROM zedge),
  zfed AS MATERIALIZED (SELECT DISTINCT z, f FROM zone JOIN fed ON fed.n = zone.n),
  ztop AS (SELECT f, z FROM src JOIN zone ON zone.n = src.n),
  bound AS (SELECT DISTINCT a AS z, gate FROM zboth WHERE NOT open),
  cust AS MATERIALIZED (
    SELECT n, sum(bt) AS bt, sum(mt) AS mt FROM (
      SELECT t.PAC_1 AS n, count(*) AS bt, 0 AS mt FROM ucbt_tab u JOIN untrmt t ON t.COD_ID = u.UNI_TR_MT GROUP BY 1
      UNION ALL SELECT PAC, 0, count(*) FROM ucmt_tab GROUP BY 1) JOIN node USING (n) GROUP BY 1),
  zcust AS MATERIALIZED (SELECT zone.z, count(*) AS nn, CAST(coalesce(sum(bt), 0) AS BIGINT) AS bt, CAST(coalesce(sum(mt), 0) AS BIGINT) AS mt FROM zone LEFT JOIN cust USING (n) GROUP BY 1)
"""
_LOST = """
  after_(z, v) AS (SELECT zf.z, ztop.z FROM zfed zf JOIN ztop ON ztop.f = zf.f
                   UNION SELECT after_.z, e.b FROM after_ JOIN zboth e ON e.a = after_.v AND NOT e.open AND e.a <> after_.z AND e.b <> after_.z),
  lost AS MATERIALIZED (SELECT zf.z, v.z AS v, zf.f FROM zfed zf JOIN zfed v ON v.f = zf.f AND v.z <> zf.z
           WHERE NOT EXISTS (SELECT 1 FROM after_ x WHERE x.z = zf.z AND x.v = v.z)),
  lr(z, s, v) AS (SELECT z, v, v FROM lost UNION SELECT lr.z, lr.s, e.b FROM lr JOIN zboth e ON e.a = lr.v AND NOT e.open JOIN lost l ON l.z = lr.z AND l.v = e.b),
  piece AS MATERIALIZED (SELECT z, s AS v, min(v) AS p FROM lr GROUP BY 1, 2)
"""
_OPTIONS = """
  alive AS (SELECT p.z, e.gate, e.ctmt, e.tlcd, zf.f, row_number() OVER (PARTITION BY p.z, e.gate ORDER BY e.side) AS r
            FROM piece p JOIN zboth e ON e.a = p.v AND e.open JOIN zfed zf ON zf.z = e.b
            WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.z = p.z AND l.v = e.b) AND (e.b <> p.z OR e.b IN (SELECT z FROM ztop))),
  touched AS (SELECT DISTINCT p.z, e.gate, p.p FROM piece p JOIN zboth e ON e.a = p.v AND e.open),
  psum AS (SELECT piece.z, p, sum(nn) AS nn, sum(bt) AS bt, sum(mt) AS mt FROM piece JOIN zcust ON zcust.z = piece.v GROUP BY 1, 2),
  opt AS MATERIALIZED (SELECT a.z AS zone, a.gate AS chave, a.f AS fonte, a.ctmt, a.tlcd = 1 AS tlcd, CAST(sum(nn) AS BIGINT) AS nos, CAST(sum(bt) AS BIGINT) AS ucbt,
           CAST(sum(mt) AS BIGINT) AS ucmt FROM alive a JOIN touched t ON t.z = a.z AND t.gate = a.gate JOIN psum ON psum.z = a.z AND psum.p = t.p
           WHERE a.r = 1 GROUP BY ALL)
"""
_NETWORK = ("CTMT", "SSDMT", "UNSEMT", "INTERLIGACOES", "UNTRMT", "UCBT_tab", "UCMT_tab")


# --- inventory and clips -------------------------------------------------------------------------


@query(
    "entity_inventory",
    with_grid(
        """
  tm AS (SELECT COD_ID, CTMT FROM untrmt),
  sg AS (SELECT CTMT, sum(CAST(COMP AS DECIMAL(28,6))) AS km FROM ssdmt GROUP BY 1),
  tr AS (SELECT CTMT, count(*) AS n, sum(CAST(POT_NOM AS DECIMAL(28,6))) AS kva FROM untrmt GROUP BY 1),
  mu AS (SELECT CTMT, MUN FROM (SELECT CTMT, MUN, row_number() OVER (PARTITION BY CTMT ORDER BY count(*) DESC, MUN) AS r FROM untrmt GROUP BY 1, 2) WHERE r = 1),
  sw AS (SELECT CTMT, count(*) AS n, count(*) FILTER (P_N_OPE = 'A') AS na, count(*) FILTER (P_N_OPE = 'F') AS nf, count(*) FILTER (TLCD = 1) AS tl FROM unsemt GROUP BY 1),
  ts AS (SELECT COD_ID, CTMT, CTMT_VIZ, TLCD, EM_SUB FROM interligacoes UNION ALL SELECT COD_ID, CTMT_VIZ, CTMT, TLCD, EM_SUB FROM interligacoes),
  tc AS (SELECT CTMT, count(DISTINCT COD_ID) AS a, count(DISTINCT CASE WHEN TLCD = 1 THEN COD_ID END) AS b, count(DISTINCT CASE WHEN EM_SUB THEN COD_ID END) AS c,
           count(DISTINCT CASE WHEN NOT EM_SUB THEN COD_ID END) AS d, count(DISTINCT CASE WHEN NOT EM_SUB AND TLCD = 1 THEN COD_ID END) AS e,
           count(DISTINCT CTMT_VIZ) AS nv, string_agg(DISTINCT CTMT_VIZ, ';' ORDER BY CTMT_VIZ) AS vz FROM ts GROUP BY 1),
  lv AS (SELECT coalesce(tm.CTMT, u.CTMT) AS k, count(*) AS n, sum(CAST(ENE_01 AS DECIMAL(28,6))) AS e FROM ucbt_tab u LEFT JOIN tm ON tm.COD_ID = u.UNI_TR_MT GROUP BY 1),
  mv AS (SELECT CTMT AS k, count(*) AS n, sum(CAST(ENE_01 AS DECIMAL(28,6))) AS e FROM ucmt_tab GROUP BY 1),
  gl AS (SELECT coalesce(tm.CTMT, u.CTMT) AS k, count(*) AS n, CAST(sum(CAST(POT_INST AS DECIMAL(28,6))) AS DOUBLE) AS e FROM ugbt_tab u LEFT JOIN tm ON tm.COD_ID = u.UNI_TR_MT GROUP BY 1),
  gm AS (SELECT CTMT AS k, count(*) AS n, CAST(sum(CAST(POT_INST AS DECIMAL(28,6))) AS DOUBLE) AS e FROM ugmt_tab GROUP BY 1)
SELECT f.COD_ID, f.NOME, split_part(trim(f.NOME), ' ', 1) AS tipo, f.SUB, s.NOME AS SUB_NOME, f.UNI_TR_AT, f.TEN_NOM, CAST(CASE f.TEN_NOM WHEN '46' THEN 13.2 ELSE 13.8 END AS DOUBLE) AS TEN_NOM_kV,
  mu.MUN, coalesce(round_even(CAST(sg.km AS DOUBLE) / 1000.0 * 1000, 0) / 1000, 0) AS km_MT, round_even(f.ENE_01 / 1000.0 * 1000, 0) / 1000 AS ENE_MWh_ano,
  round_even((coalesce(CAST(lv.e AS DOUBLE), 0) + coalesce(CAST(mv.e AS DOUBLE), 0)) / 1000.0 * 1000, 0) / 1000 AS ENE_UC_MWh_ano,
  coalesce(tr.n, 0) AS n_UNTRMT, round_even(CAST(tr.kva AS DOUBLE) * 1000, 0) / 1000 AS kVA_instalado, coalesce(lv.n, 0) AS n_UCBT, coalesce(mv.n, 0) AS n_UCMT,
  coalesce(gl.n, 0) + coalesce(gm.n, 0) AS n_DER, round_even((coalesce(gl.e, 0) + coalesce(gm.e, 0)) * 1000, 0) / 1000 AS kW_DER,
  coalesce(sw.n, 0) AS chaves_total, coalesce(sw.na, 0) AS chaves_NA, coalesce(sw.nf, 0) AS chaves_NF, coalesce(sw.tl, 0) AS chaves_telecomandadas,
  coalesce(tc.a, 0) AS NA_interligacao, coalesce(tc.b, 0) AS NA_interligacao_telecomandada, coalesce(tc.c, 0) AS NA_interligacao_SE, coalesce(tc.d, 0) AS NA_interligacao_campo,
  coalesce(tc.e, 0) AS NA_interligacao_campo_telecomandada, coalesce(tc.nv, 0) AS n_vizinhos, coalesce(tc.vz, '') AS vizinhos, 0 AS n_UNREMT, 0 AS n_UNCRMT,
  CAST(NULL AS DOUBLE) AS lon_min, CAST(NULL AS DOUBLE) AS lat_min, CAST(NULL AS DOUBLE) AS lon_max, CAST(NULL AS DOUBLE) AS lat_max,
  coalesce(tc.d, 0) * (coalesce(lv.n, 0) + coalesce(mv.n, 0)) AS score
FROM ctmt f LEFT JOIN sub s ON s.COD_ID = f.SUB LEFT JOIN sg ON sg.CTMT = f.COD_ID LEFT JOIN tr ON tr.CTMT = f.COD_ID LEFT JOIN mu ON mu.CTMT = f.COD_ID
  LEFT JOIN sw ON sw.CTMT = f.COD_ID LEFT JOIN tc ON tc.CTMT = f.COD_ID LEFT JOIN lv ON lv.k = f.COD_ID LEFT JOIN mv ON mv.k = f.COD_ID
  LEFT JOIN gl ON gl.k = f.COD_ID LEFT JOIN gm ON gm.k = f.COD_ID
""",
        "CTMT", "SUB", "SSDMT", "UNSEMT", "INTERLIGACOES", "UNTRMT", "UCBT_tab", "UCMT_tab", "UGBT_tab", "UGMT_tab", recursive=False,
    ),
)
def entity_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """The whole inventory; ties are given, geometry is absent."""
    lay = layers(spark, sf)
    frames = {k: v for k, v in lay.items() if k != "INTERLIGACOES"}
    return feeder_inventory(LayerCatalog.of(spark, frames), ties=lay["INTERLIGACOES"])


@query("top_feeders", f"SELECT * FROM ({ORACLES['entity_inventory']}) ORDER BY score DESC, NA_interligacao_campo DESC, n_UCBT DESC, COD_ID LIMIT 10")
def top_feeders_query(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best feeders."""
    return top_feeders(entity_inventory(spark, sf), 10)


@query(
    "clip_chain",
    with_grid(
        """
  br AS (SELECT COD_ID AS clip_id, COD_ID AS ctmt FROM ctmt UNION SELECT SUB, COD_ID FROM ctmt),
  f AS (SELECT br.clip_id, c.* FROM br JOIN ctmt c ON c.COD_ID = br.ctmt),
  su AS (SELECT DISTINCT f.clip_id, s.COD_ID FROM f JOIN sub s ON s.COD_ID = f.SUB),
  sg AS (SELECT br.clip_id, x.* FROM br JOIN ssdmt x ON x.CTMT = br.ctmt),
  sw AS (SELECT br.clip_id, x.* FROM br JOIN unsemt x ON x.CTMT = br.ctmt),
  tr AS (SELECT br.clip_id, x.* FROM br JOIN untrmt x ON x.CTMT = br.ctmt),
  mv AS (SELECT br.clip_id, x.* FROM br JOIN ucmt_tab x ON x.CTMT = br.ctmt),
  gm AS (SELECT br.clip_id, x.* FROM br JOIN ugmt_tab x ON x.CTMT = br.ctmt),
  tk AS (SELECT DISTINCT clip_id, COD_ID AS t FROM tr),
  lv AS (SELECT tk.clip_id, x.* FROM tk JOIN ucbt_tab x ON x.UNI_TR_MT = tk.t),
  gl AS (SELECT tk.clip_id, x.* FROM tk JOIN ugbt_tab x ON x.UNI_TR_MT = tk.t),
  po AS (SELECT DISTINCT lv.clip_id, p.COD_ID FROM lv JOIN ponnot p ON p.COD_ID = lv.PN_CON),
  co AS (SELECT DISTINCT sg.clip_id, c.COD_ID FROM sg JOIN segcon c ON c.COD_ID = sg.TIP_CND),
  cv AS (SELECT DISTINCT lv.clip_id, c.COD_ID FROM lv JOIN crvcrg c ON c.COD_ID = lv.TIP_CC),
  ti AS (SELECT DISTINCT br.clip_id, i.COD_ID, i.CTMT_VIZ FROM interligacoes i JOIN br ON br.ctmt = i.CTMT OR br.ctmt = i.CTMT_VIZ),
  n AS (SELECT clip_id, 'CTMT' AS layer FROM f UNION ALL SELECT clip_id, 'SUB' FROM su UNION ALL SELECT clip_id, 'SSDMT' FROM sg UNION ALL SELECT clip_id, 'UNSEMT' FROM sw
        UNION ALL SELECT clip_id, 'UNTRMT' FROM tr UNION ALL SELECT clip_id, 'UCMT_tab' FROM mv UNION ALL SELECT clip_id, 'UGMT_tab' FROM gm UNION ALL SELECT clip_id, 'UCBT_tab' FROM lv
        UNION ALL SELECT clip_id, 'UGBT_tab' FROM gl UNION ALL SELECT clip_id, 'PONNOT' FROM po UNION ALL SELECT clip_id, 'SEGCON' FROM co UNION ALL SELECT clip_id, 'CRVCRG' FROM cv
        UNION ALL SELECT clip_id, 'INTERLIGACOES' FROM ti),
  ly AS (SELECT DISTINCT clip_id, unnest(['CTMT','SUB','SSDMT','UNSEMT','UNTRMT','UCMT_tab','UGMT_tab','UCBT_tab','UGBT_tab','PONNOT','SEGCON','CRVCRG','INTERLIGACOES']) AS layer FROM br)
SELECT ly.clip_id, ly.layer, count(n.layer) AS n FROM ly LEFT JOIN n ON n.clip_id = ly.clip_id AND n.layer = ly.layer GROUP BY 1, 2
""",
        "CTMT", "SUB", "SSDMT", "UNSEMT", "UNTRMT", "UCMT_tab", "UGMT_tab", "UCBT_tab", "UGBT_tab", "PONNOT", "SEGCON", "CRVCRG", "INTERLIGACOES", recursive=False,
    ),
)
def clip_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Every feeder and every substation's feeders as a clip, rows per layer."""
    lay = layers(spark, sf)
    feeders = lay["CTMT"]
    bridge = feeders.select(F.col("COD_ID").alias("clip_id"), F.col("COD_ID").alias("ctmt")).unionByName(
        feeders.select(F.col("SUB").alias("clip_id"), F.col("COD_ID").alias("ctmt"))
    )
    frames = {k: v for k, v in lay.items() if k != "INTERLIGACOES"}
    selected = clip.select_layers(LayerCatalog.of(spark, frames), bridge, ties=lay["INTERLIGACOES"])
    return clip.clip_counts(selected, bridge)


@query(
    "clip_neighbours",
    with_grid(
        """
  br AS (SELECT COD_ID AS clip_id, COD_ID AS ctmt FROM ctmt UNION SELECT SUB, COD_ID FROM ctmt),
  s AS (SELECT CTMT AS a, CTMT_VIZ AS b, COD_ID, TLCD, EM_SUB FROM interligacoes UNION SELECT CTMT_VIZ, CTMT, COD_ID, TLCD, EM_SUB FROM interligacoes),
  g AS (SELECT a, b, count(*) AS ties, count(*) FILTER (NOT EM_SUB) AS campo, count(*) FILTER (EM_SUB) AS se FROM s GROUP BY 1, 2)
SELECT br.clip_id, g.a AS CTMT, g.b AS CTMT_VIZ, g.ties, g.campo AS ties_campo, g.se AS "ties_em_SE" FROM g JOIN br ON br.ctmt = g.a
LEFT JOIN br i ON i.clip_id = br.clip_id AND i.ctmt = g.b WHERE i.ctmt IS NULL OR g.a < g.b
""",
        "CTMT", "INTERLIGACOES", recursive=False,
    ),
)
def clip_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """A41, A10."""
    lay = layers(spark, sf)
    feeders = lay["CTMT"]
    bridge = feeders.select(F.col("COD_ID").alias("clip_id"), F.col("COD_ID").alias("ctmt")).unionByName(
        feeders.select(F.col("SUB").alias("clip_id"), F.col("COD_ID").alias("ctmt"))
    )
    return clip.clip_neighbours(bridge, lay["INTERLIGACOES"]).select("clip_id", "CTMT", "CTMT_VIZ", "ties", "ties_campo", "ties_em_SE")


# --- network -------------------------------------------------------------------------------------


@query("graph_edges", with_grid(_EDGES + "SELECT id AS edge_id, kind, u AS src, v AS dst, ctmt, comp, open, tlcd = 1 AS tlcd FROM edge", *_NETWORK[:4]))
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """N1, N3, P7."""
    return grid(spark, sf)["edges"].select(
        "edge_id", "kind", "src", "dst", "ctmt", "comp", "open", F.when(F.col("kind") == "trecho", False).otherwise(F.col("tlcd")).alias("tlcd")
    )


@query(
    "rejected_edges",
    with_grid(
        """
  raw AS (SELECT 0 AS p, COD_ID AS id, 'trecho' AS kind, PAC_1 AS u, PAC_2 AS v, CTMT AS ctmt FROM ssdmt UNION ALL SELECT 1, COD_ID, 'chave', PAC_1, PAC_2, CTMT FROM unsemt)
SELECT id AS edge_id, kind, ctmt, CASE WHEN u = v THEN 'pac_ausente_ou_repetido' ELSE 'par_de_pac_ja_usado' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY p, id, u) AS r FROM raw) WHERE u = v OR r > 1
""",
        "SSDMT", "UNSEMT", recursive=False,
    ),
)
def rejected_edges(spark: SparkSession, sf: str) -> DataFrame:
    """What the edge rules leave out."""
    lay = grid(spark, sf)
    return net.rejected_edges(lay["SSDMT"], lay["UNSEMT"])


@query("energised", with_grid(_EDGES + "," + _FED + "SELECT n AS node, f AS fed_by FROM fed", *_NETWORK[:4]))
def energised(spark: SparkSession, sf: str) -> DataFrame:
    """N2, N4, N5."""
    return fed(spark, sf)


@query("zones", with_grid(_EDGES + "," + _FED + "," + _ZONES + "SELECT n AS node, z AS zone FROM zone", *_NETWORK))
def zones_query(spark: SparkSession, sf: str) -> DataFrame:
    """N9."""
    return grid(spark, sf)["labels"].select("node", "zone")


@query(
    "isolation",
    with_grid(
        _EDGES + "," + _FED + "," + _ZONES + "," + _LOST
        + """,
  o AS (SELECT z, string_agg(gate, ';' ORDER BY gate) AS g FROM bound GROUP BY 1),
  l AS (SELECT lost.z, sum(nn) AS nn, sum(bt) AS bt, sum(mt) AS mt FROM lost JOIN zcust ON zcust.z = lost.v GROUP BY 1)
SELECT c.z AS zone, coalesce(o.g, '') AS chaves, c.nn AS nos_zona, c.bt AS zona_ucbt, c.mt AS zona_ucmt, CAST(coalesce(l.nn, 0) AS BIGINT) AS nos_desligados,
       CAST(coalesce(l.bt, 0) AS BIGINT) AS desligados_ucbt, CAST(coalesce(l.mt, 0) AS BIGINT) AS desligados_ucmt
FROM zcust c LEFT JOIN o ON o.z = c.z LEFT JOIN l ON l.z = c.z
""",
        *_NETWORK,
    ),
)
def isolation(spark: SparkSession, sf: str) -> DataFrame:
    """N10, A23."""
    return rst.isolation_table(*zones(spark, sf)).drop("zona_trafos", "desligados_trafos")


@query(
    "restoration",
    with_grid(
        _EDGES + "," + _FED + "," + _ZONES + "," + _LOST + "," + _OPTIONS
        + """,
  fc AS (SELECT zf.f, sum(bt + mt) AS n FROM zfed zf JOIN zcust ON zcust.z = zf.z GROUP BY 1),
  down AS (SELECT l.z, l.f, sum(bt + mt) AS n FROM lost l JOIN zcust ON zcust.z = l.v GROUP BY 1, 2),
  own AS (SELECT zf.z, zf.f, bt + mt AS n FROM zfed zf JOIN zcust ON zcust.z = zf.z WHERE zf.z NOT IN (SELECT z FROM ztop))
SELECT o.zone, chave, o.ctmt AS ctmt_chave, fonte, tlcd, nos, ucbt, ucmt, ucbt + ucmt AS clientes,
       CAST(coalesce(fc.n, 0) - coalesce(down.n, 0) - coalesce(own.n, 0) AS BIGINT) AS clientes_fonte,
       row_number() OVER (PARTITION BY o.zone ORDER BY ucbt + ucmt DESC, tlcd DESC, chave) AS ordem
FROM opt o LEFT JOIN fc ON fc.f = fonte LEFT JOIN down ON down.z = o.zone AND down.f = fonte LEFT JOIN own ON own.z = o.zone AND own.f = fonte
""",
        *_NETWORK,
    ),
)
def restoration(spark: SparkSession, sf: str) -> DataFrame:
    """N11, W5."""
    return options(spark, sf).drop("tip_unid", "externa", "trafos", "kva")


def _piece(cut: str = "cut"):
    return F.concat(F.col(cut), F.lit("|"), F.col("component")).alias("node")


def option_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces each option recovers; a piece stands for its nodes, whose totals are already summed."""
    return rst.recovered_components(*zones(spark, sf), grid(spark, sf)["located"]).select(F.col("cut").alias("zone"), F.col("gate").alias("chave"), _piece())


@query(
    "impact",
    with_grid(
        _EDGES + "," + _FED + "," + _ZONES + "," + _LOST + "," + _OPTIONS
        + """,
  nr AS (SELECT t.PAC_1 AS n, u.CONJ AS reg, count(*) AS k FROM ucbt_tab u JOIN untrmt t ON t.COD_ID = u.UNI_TR_MT GROUP BY 1, 2
         UNION ALL SELECT PAC, CONJ, count(*) FROM ucmt_tab GROUP BY 1, 2),
  zreg AS (SELECT z, reg, sum(k) AS k FROM nr JOIN zone USING (n) GROUP BY 1, 2),
  oreg AS (SELECT o.zone, o.chave, reg, sum(k) AS k FROM opt o JOIN touched t ON t.z = o.zone AND t.gate = o.chave JOIN piece p ON p.z = t.z AND p.p = t.p
           JOIN zreg ON zreg.z = p.v GROUP BY 1, 2, 3),
  top AS (SELECT zone, chave, max(k) AS k FROM oreg GROUP BY 1, 2),
  pick AS (SELECT zone, chave, CASE WHEN count(*) = 1 THEN min(reg) END AS reg FROM oreg JOIN top USING (zone, chave, k) GROUP BY 1, 2),
  tot AS (SELECT reg, sum(k) AS total FROM nr GROUP BY 1),
  dl AS (SELECT lost.z, sum(bt + mt) AS n FROM lost JOIN zcust ON zcust.z = lost.v GROUP BY 1)
SELECT o.zone, o.chave, o.ucbt + o.ucmt AS clientes_restaurados, CAST(greatest(coalesce(dl.n, 0) - (o.ucbt + o.ucmt), 0) AS BIGINT) AS clientes_sem_tensao,
       CAST((o.ucbt + o.ucmt) AS DOUBLE) * 175.0 AS consumidor_minutos, pick.reg AS region, CAST(tot.total AS BIGINT) AS total_uc,
       CASE WHEN pick.reg IS NOT NULL THEN CAST(oreg.k AS BIGINT) END AS ucs_restauradas, CAST(oreg.k AS DOUBLE) * 175.0 / CAST(tot.total AS DOUBLE) / 60.0 AS dec_horas
FROM opt o LEFT JOIN dl ON dl.z = o.zone LEFT JOIN pick ON pick.zone = o.zone AND pick.chave = o.chave LEFT JOIN tot ON tot.reg = pick.reg
LEFT JOIN oreg ON oreg.zone = o.zone AND oreg.chave = o.chave AND oreg.reg = pick.reg
""",
        *_NETWORK,
    ),
)
def impact_query(spark: SparkSession, sf: str) -> DataFrame:
    """Region by customers only."""
    g = grid(spark, sf)
    lost = rst.isolation_table(*zones(spark, sf)).select("zone", (F.col("desligados_ucbt") + F.col("desligados_ucmt")).alias("desligados"))
    graph, isolation = zones(spark, sf)
    regions = impact.node_regions(g["UNTRMT"], g["UCBT_tab"], g["UCMT_tab"]).join(graph.zones, "node").select(F.col("zone").alias("node"), "region", "n")
    touched = materialise(rst.recovered_components(graph, isolation, g["located"]), "touched")
    pieces = rst.piece_regions(graph, isolation, regions, pieces=touched).select(_piece(), "region", "n")
    nodes = touched.select(F.col("cut").alias("zone"), F.col("gate").alias("chave"), _piece())
    return impact.option_impact(
        options(spark, sf), nodes, lost, regions=materialise(pieces, "regions"),
        totals=impact.region_totals(g["UCBT_tab"], g["UCMT_tab"]),
    ).drop("tempo_reparo_min", "tempo_manobra_min", "dec_minutos", "region_name")


@query(
    "downstream",
    with_grid(
        _EDGES + "," + _FED + "," + _ZONES
        + """,
  cut(g, v) AS (SELECT b.gate, ztop.z FROM (SELECT DISTINCT gate, a FROM zboth WHERE NOT open) b JOIN zfed zf ON zf.z = b.a JOIN ztop ON ztop.f = zf.f
                UNION SELECT cut.g, e.b FROM cut JOIN zboth e ON e.a = cut.v AND NOT e.open AND e.gate <> cut.g),
  gf AS (SELECT DISTINCT gate, f FROM zboth JOIN zfed ON z = a WHERE NOT open),
  dark AS (SELECT gf.gate, zf.z FROM gf JOIN zfed zf ON zf.f = gf.f WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.g = gf.gate AND cut.v = zf.z))
SELECT gate, count(*) AS zonas, CAST(sum(nn) AS BIGINT) AS nos, CAST(sum(bt + mt) AS BIGINT) AS clientes FROM dark JOIN zcust USING (z) GROUP BY 1
""",
        *_NETWORK,
    ),
)
def downstream(spark: SparkSession, sf: str) -> DataFrame:
    """What each closed switch holds up."""
    return rst.switch_totals(grid(spark, sf)["graph"]).select("gate", "zonas", F.col("n_nodes").alias("nos"), (F.col("ucbt") + F.col("ucmt")).alias("clientes"))


_PATH = """
  walk(z, f, hops, gates) AS (SELECT z, f, 0, CAST([] AS VARCHAR[]) FROM ztop
       UNION ALL SELECT e.b, w.f, w.hops + 1, list_append(w.gates, e.gate) FROM walk w JOIN zboth e ON e.a = w.z AND NOT e.open AND NOT list_contains(w.gates, e.gate)),
  path AS (SELECT z, f, gates FROM walk WHERE hops > 0)
"""


@query(
    "fault_footprint",
    with_grid(
        _EDGES + "," + _FED + "," + _ZONES + "," + _PATH
        + """,
  fc AS (SELECT zf.f, sum(nn) AS nn, sum(bt + mt) AS n FROM zfed zf JOIN zcust ON zcust.z = zf.z WHERE zf.z NOT IN (SELECT z FROM ztop) GROUP BY 1)
SELECT p.z AS zone, p.f AS fonte, p.gates[1] AS religador, array_to_string(p.gates, ';') AS indicacoes, p.gates[-1] AS ultima_indicacao,
       CAST(fc.nn AS BIGINT) AS nos_sem_tensao, CAST(fc.n AS BIGINT) AS clientes_sem_tensao FROM path p JOIN fc ON fc.f = p.f
""",
        *_NETWORK,
    ),
)
def fault_footprint(spark: SparkSession, sf: str) -> DataFrame:
    """Everything past the breaker goes dark while it is open."""
    return once(spark, sf, "footprint", lambda: materialise(rst.fault_footprint(grid(spark, sf)["graph"]), "grid-footprint"))


@query(
    "reclose_effect",
    with_grid(
        _EDGES + "," + _FED + "," + _ZONES + "," + _LOST + "," + _PATH
        + """,
  fc AS (SELECT zf.f, zf.z, nn, bt + mt AS n FROM zfed zf JOIN zcust ON zcust.z = zf.z WHERE zf.z NOT IN (SELECT z FROM ztop)),
  pr AS (SELECT p.z, p.f, p.gates[1] AS rel, NOT EXISTS (SELECT 1 FROM bound b WHERE b.z = p.z AND b.gate = p.gates[1]) AS rlg FROM path p),
  bk AS (SELECT pr.z, sum(nn) AS nn, sum(n) AS n FROM pr JOIN fc ON fc.f = pr.f AND fc.z <> pr.z WHERE rlg AND NOT EXISTS (SELECT 1 FROM lost l WHERE l.z = pr.z AND l.v = fc.z) GROUP BY 1)
SELECT pr.z AS zone, rel AS religador, rlg AS religar, CAST(coalesce(bk.nn, 0) AS BIGINT) AS nos_religados, CAST(coalesce(bk.n, 0) AS BIGINT) AS clientes_religados FROM pr LEFT JOIN bk ON bk.z = pr.z
""",
        *_NETWORK,
    ),
)
def reclose_effect(spark: SparkSession, sf: str) -> DataFrame:
    """N15."""
    return rst.reclose_effect(*zones(spark, sf), fault_footprint(spark, sf))


@query(
    "step_sequence",
    with_grid(
        _EDGES + "," + _FED + "," + _ZONES + "," + _LOST + "," + _OPTIONS
        + """,
  st AS (SELECT o.zone, o.chave, 0 AS k, 'abrir' AS action, b.gate AS switch_id FROM opt o JOIN bound b ON b.z = o.zone UNION ALL SELECT zone, chave, 1, 'fechar', chave FROM opt)
SELECT zone, chave, CAST(row_number() OVER (PARTITION BY zone, chave ORDER BY k, switch_id) AS INTEGER) AS step, action, switch_id FROM st
""",
        *_NETWORK,
    ),
)
def step_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Open the boundary, then close the option's switch."""
    return rst.step_sequence(options(spark, sf), zones(spark, sf)[1])


@query(
    "node_downstream",
    with_grid(
        _EDGES + "," + _FED
        + """,
  cb(x, n) AS (SELECT x.n, s.n FROM fed x JOIN src s ON s.f = x.f AND s.n <> x.n UNION SELECT cb.x, b.b FROM cb JOIN both_ b ON b.a = cb.n AND NOT b.open AND b.b <> cb.x)
SELECT x.n AS node, count(*) AS n FROM fed x JOIN fed y ON y.f = x.f WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.x = x.n AND cb.n = y.n) GROUP BY 1
""",
        *_NETWORK[:4],
    ),
)
def node_downstream(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes hang on each node."""
    g = grid(spark, sf)
    return rst.node_totals(g["edges"], g["sources"])


@query(
    "trunk_segments",
    with_grid(
        _EDGES
        + """,
  tv(n, f) AS (SELECT n, f FROM src UNION SELECT b.b, tv.f FROM tv JOIN both_ b ON b.a = tv.n AND b.kind = 'chave' AND NOT b.open),
  tk AS (SELECT DISTINCT tv.f, e.id, e.comp FROM tv JOIN edge e ON e.kind = 'trecho' AND (e.u = tv.n OR e.v = tv.n))
SELECT f AS ctmt, id AS edge_id, comp, row_number() OVER (PARTITION BY f ORDER BY comp DESC, id DESC) = 1 AS maior FROM tk
""",
        *_NETWORK[:4],
    ),
)
def trunk_segments(spark: SparkSession, sf: str) -> DataFrame:
    """N16, T5."""
    g = grid(spark, sf)
    trunk = materialise(net.trunk_segments(g["edges"], g["sources"]), "trunk")
    best = net.longest_trunk(trunk).select("ctmt", "edge_id", F.lit(True).alias("_best"))
    return trunk.join(best, ["ctmt", "edge_id"], "left").select("ctmt", "edge_id", "comp", F.coalesce("_best", F.lit(False)).alias("maior"))


@query(
    "network_summary",
    with_grid(
        _EDGES + "," + _FED + "," + _ZONES
        + """,
  en AS (SELECT u AS n, kind, id, ctmt FROM edge UNION ALL SELECT v, kind, id, ctmt FROM edge),
  nf AS (SELECT n, arg_min(ctmt, (CASE kind WHEN 'trecho' THEN 0 WHEN 'chave' THEN 1 ELSE 2 END, id)) AS f FROM en GROUP BY 1),
  a AS (SELECT f, count(*) AS nos, count(fed.n) AS energizados, CAST(coalesce(sum(bt), 0) AS BIGINT) AS ucbt, CAST(coalesce(sum(mt), 0) AS BIGINT) AS ucmt
        FROM nf LEFT JOIN (SELECT n FROM fed) fed ON fed.n = nf.n LEFT JOIN cust ON cust.n = nf.n GROUP BY 1),
  b AS (SELECT ctmt, count(*) FILTER (kind = 'trecho') AS trechos, count(*) FILTER (kind = 'chave') AS chaves, count(*) FILTER (kind = 'chave' AND open) AS "chaves_NA",
          count(*) FILTER (kind = 'chave' AND NOT open) AS "chaves_NF", count(*) FILTER (kind = 'tie') AS ties,
          round_even(coalesce(CAST(sum(CAST(comp AS DECIMAL(28,6))) AS DOUBLE) / 1000, 0) * 1000, 0) / 1000 AS km FROM edge GROUP BY 1)
SELECT a.f AS cluster_id, nos, energizados, ucbt, ucmt, trechos, chaves, "chaves_NA", "chaves_NF", ties, km FROM a LEFT JOIN b ON b.ctmt = a.f
""",
        *_NETWORK,
    ),
)
def network_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A39."""
    g = grid(spark, sf)
    out = net.network_summary(g["edges"], net.build_nodes(g["edges"]), fed(spark, sf), g["customers"])
    return out.drop("trafos", "kva", "ties_externas")


@query(
    "switch_dossier",
    with_grid(
        _EDGES + "," + _FED
        + """
SELECT e.id AS chave, e.ctmt, CASE WHEN e.open THEN 'aberta' ELSE 'fechada' END AS estado, e.u AS pac_1, e.v AS pac_2, a.f AS fed_src, b.f AS fed_dst
FROM edge e LEFT JOIN fed a ON a.n = e.u LEFT JOIN fed b ON b.n = e.v WHERE e.kind = 'chave'
""",
        *_NETWORK[:4],
    ),
)
def switch_dossier(spark: SparkSession, sf: str) -> DataFrame:
    """N22."""
    return net.switch_dossier(grid(spark, sf)["edges"], fed(spark, sf)).drop("normal", "tlcd", "tip_unid", "externa")


@query(
    "network_state",
    with_grid(
        _EDGES + "," + _FED
        + """
SELECT CASE WHEN e.kind = 'trecho' THEN 'SSDMT' ELSE 'UNSEMT' END AS camada, CASE WHEN e.kind = 'trecho' THEN a.f ELSE coalesce(a.f, b.f) END AS fonte, count(*) AS n,
       count(*) FILTER (e.kind = 'chave' AND EXISTS (SELECT 1 FROM edge t WHERE t.kind = 'tie' AND split_part(t.id, '|', 1) = e.id)) AS ties
FROM edge e LEFT JOIN fed a ON a.n = e.u LEFT JOIN fed b ON b.n = e.v WHERE e.kind <> 'tie' GROUP BY 1, 2
""",
        *_NETWORK[:4],
    ),
)
def network_state_query(spark: SparkSession, sf: str) -> DataFrame:
    """Features by layer and feeding source."""
    state = network_state(grid(spark, sf)["edges"], fed(spark, sf))
    return state.groupBy("camada", "fonte").agg(F.count(F.lit(1)).alias("n"), F.count_if("tie").alias("ties"))


@query(
    "plan_state",
    with_grid(
        _EDGES
        + """,
  sn AS (SELECT u, v, CASE WHEN kind = 'trecho' THEN false WHEN tlcd = 1 AND gate IS NOT NULL THEN NOT open ELSE open END AS open FROM edge),
  sb AS (SELECT u AS a, v AS b FROM sn WHERE NOT open UNION ALL SELECT v, u FROM sn WHERE NOT open),
  rr(n) AS (SELECT n FROM src UNION SELECT b FROM rr JOIN sb ON a = n)
SELECT node.n AS node, rr.n IS NOT NULL AS energizado FROM node LEFT JOIN rr ON rr.n = node.n
""",
        *_NETWORK[:4],
    ),
)
def plan_state(spark: SparkSession, sf: str) -> DataFrame:
    """Every remote switch changes position; which nodes still have supply."""
    g = grid(spark, sf)
    remote = g["edges"].where("kind = 'chave' and tlcd")
    steps = remote.select(
        F.lit(1).alias("step"), F.when(F.col("open"), "fechar").otherwise("abrir").alias("action"), F.col("edge_id").alias("switch_id")
    )
    after = materialise(net.apply_plan(g["edges"], steps), "plan")
    live = net.energised(after, g["sources"]).select("node", F.lit(True).alias("_on"))
    nodes = after.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(live, "node", "left").select("node", F.coalesce("_on", F.lit(False)).alias("energizado"))


# --- tie atlas -----------------------------------------------------------------------------------


def atlas_parts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    def build() -> dict[str, DataFrame]:
        lay = layers(spark, sf)
        field = lay["INTERLIGACOES"].where(~F.col("EM_SUB"))
        counts = lay["UCMT_tab"].groupBy(F.col("CTMT").alias("COD_ID")).agg(F.count(F.lit(1)).alias("n_clientes"))
        pairs = both_directions(field).groupBy(F.col("CTMT").alias("COD_ID")).agg(
            F.count_distinct("COD_ID").alias("NA_interligacao_campo"),
            F.count_distinct(F.when(F.col("TLCD") == 1, F.col("COD_ID"))).alias("NA_interligacao_campo_telecomandada"),
        )
        feeders = lay["CTMT"].select("COD_ID", "SUB").join(lay["SUB"].select(F.col("COD_ID").alias("SUB"), F.col("NOME").alias("SUB_NOME")), "SUB", "left")
        feeders = feeders.withColumns({"CONJ_CODIGO": F.col("SUB"), "CONJ_NOME": F.col("SUB_NOME")}).join(counts, "COD_ID", "left").join(pairs, "COD_ID", "left").na.fill(0)
        feeders = materialise(feeders, "atlas-feeders")
        edges = materialise(atlas.tie_edges(field, feeders), "atlas-edges")
        members = atlas.feeder_components(feeders, edges)
        components = materialise(atlas.component_table(members, feeders, edges), "atlas-components")
        return {"ties": field, "feeders": feeders, "edges": edges, "members": members, "components": components}

    return once(spark, sf, "atlas", build)


_ATLAS = """
  fi AS (SELECT * FROM interligacoes WHERE NOT EM_SUB),
  ed AS MATERIALIZED (SELECT least(CTMT, CTMT_VIZ) AS a, greatest(CTMT, CTMT_VIZ) AS b, count(DISTINCT COD_ID) AS n, count(DISTINCT CASE WHEN TLCD = 1 THEN COD_ID END) AS nt,
         string_agg(DISTINCT COD_ID, ';' ORDER BY COD_ID) AS ch FROM fi GROUP BY 1, 2),
  dg AS (SELECT c.COD_ID AS f, count(x.f) AS g FROM ctmt c LEFT JOIN (SELECT a AS f FROM ed UNION ALL SELECT b FROM ed) x ON x.f = c.COD_ID GROUP BY 1),
  cl AS (SELECT CTMT AS f, count(*) AS n FROM ucmt_tab GROUP BY 1),
  ab AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
  cr(s, n) AS (SELECT COD_ID, COD_ID FROM ctmt UNION SELECT cr.s, ab.b FROM cr JOIN ab ON ab.a = cr.n),
  comp AS (SELECT s AS f, min(n) AS c FROM cr GROUP BY 1)
"""


@query("atlas_edges", with_grid(_ATLAS + "SELECT a AS CTMT_A, b AS CTMT_B, n AS n_ties_campo, nt AS n_ties_telecomandadas, ch AS chaves, sa.SUB AS SUB_A, sb.SUB AS SUB_B FROM ed JOIN ctmt sa ON sa.COD_ID = a JOIN ctmt sb ON sb.COD_ID = b", "CTMT", "INTERLIGACOES", "UCMT_tab"))
def atlas_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A29."""
    return atlas_parts(spark, sf)["edges"].select("CTMT_A", "CTMT_B", "n_ties_campo", "n_ties_telecomandadas", "chaves", "SUB_A", "SUB_B")


@query(
    "degree_distribution",
    with_grid(
        _ATLAS
        + """
SELECT g AS grau, count(*) AS alimentadores, count(*) * 100.0 / sum(count(*)) OVER () AS pct_alimentadores, CAST(sum(coalesce(n, 0)) AS BIGINT) AS clientes,
       CAST(sum(coalesce(n, 0)) AS DOUBLE) * 100.0 / CAST(sum(sum(coalesce(n, 0))) OVER () AS DOUBLE) AS pct_clientes FROM dg LEFT JOIN cl ON cl.f = dg.f GROUP BY 1
""",
        "CTMT", "INTERLIGACOES", "UCMT_tab",
    ).replace("count(*) * 100.0 / sum(count(*)) OVER ()", "CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE)"),
)
def degree_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """A30."""
    parts = atlas_parts(spark, sf)
    return atlas.degree_distribution(atlas.degree_table(parts["feeders"], parts["edges"]))


@query(
    "components",
    with_grid(
        _ATLAS
        + """,
  k AS (SELECT comp.c, count(*) AS n, CAST(sum(coalesce(cl.n, 0)) AS BIGINT) AS cli, string_agg(comp.f, ';' ORDER BY comp.f) AS all_ FROM comp LEFT JOIN cl ON cl.f = comp.f GROUP BY 1),
  e AS (SELECT comp.c, count(*) AS ne, sum(ed.n) AS nt FROM ed JOIN comp ON comp.f = ed.a GROUP BY 1)
SELECT row_number() OVER (ORDER BY k.n DESC, k.c) AS componente_id, k.c AS component, k.n AS n_alimentadores, cli AS n_clientes, coalesce(ne, 0) AS n_arestas,
       CAST(coalesce(nt, 0) AS BIGINT) AS n_ties_campo, array_to_string(string_split(all_, ';')[1:10], ';') AS amostra_ctmts FROM k LEFT JOIN e ON e.c = k.c
""",
        "CTMT", "INTERLIGACOES", "UCMT_tab",
    ),
)
def components(spark: SparkSession, sf: str) -> DataFrame:
    """N4, N20."""
    return atlas_parts(spark, sf)["components"].drop("n_subestacoes")


@query(
    "atlas_by_feeder",
    with_grid(
        _ATLAS
        + """,
  s AS (SELECT CTMT AS f, CTMT_VIZ AS v, COD_ID FROM fi UNION ALL SELECT CTMT_VIZ, CTMT, COD_ID FROM fi),
  h AS (SELECT s.f, count(*) AS pares, string_agg(DISTINCT v, ';' ORDER BY v) AS al, string_agg(DISTINCT c.SUB, ';' ORDER BY c.SUB) AS su, string_agg(DISTINCT s.COD_ID, ';' ORDER BY s.COD_ID) AS ch
        FROM s JOIN ctmt c ON c.COD_ID = s.v GROUP BY 1),
  k AS (SELECT c, count(*) AS n FROM comp GROUP BY 1)
SELECT dg.f AS COD_ID, dg.g AS grau, dg.g = 0 AS sem_socorro, coalesce(h.pares, 0) AS pares_ctmt_vizinho, coalesce(h.al, '') AS alimentadores_socorro, coalesce(h.su, '') AS subestacoes_socorro,
       coalesce(h.ch, '') AS chaves_campo, k.n AS tamanho_componente FROM dg JOIN comp ON comp.f = dg.f JOIN k ON k.c = comp.c LEFT JOIN h ON h.f = dg.f
""",
        "CTMT", "INTERLIGACOES", "UCMT_tab",
    ),
)
def atlas_by_feeder(spark: SparkSession, sf: str) -> DataFrame:
    """A32."""
    p = atlas_parts(spark, sf)
    out = atlas.atlas_by_feeder(p["feeders"], p["ties"], p["edges"], p["members"], p["components"])
    return out.select("COD_ID", "grau", "sem_socorro", "pares_ctmt_vizinho", "alimentadores_socorro", "subestacoes_socorro", "chaves_campo", "tamanho_componente")


@query(
    "atlas_headline",
    with_grid(
        _ATLAS
        + """,
  k AS (SELECT c, count(*) AS n FROM comp GROUP BY 1)
SELECT (SELECT count(DISTINCT COD_ID) FROM fi) AS n_ties_campo, (SELECT count(*) FROM ed) AS n_arestas, (SELECT count(*) FROM dg) AS n_alimentadores, (SELECT count(*) FROM dg WHERE g = 0) AS n_grau_zero,
       (SELECT count(*) FROM k) AS n_componentes, (SELECT max(n) FROM k) AS maior_componente, (SELECT max(g) FROM dg) AS grau_maximo, (SELECT count(*) FROM ucmt_tab) AS n_clientes_total
""",
        "CTMT", "INTERLIGACOES", "UCMT_tab",
    ),
)
def atlas_headline(spark: SparkSession, sf: str) -> DataFrame:
    """A31."""
    p = atlas_parts(spark, sf)
    out = atlas.atlas_headline(p["ties"], p["edges"], atlas.degree_table(p["feeders"], p["edges"]), p["components"])
    return out.select("n_ties_campo", "n_arestas", "n_alimentadores", "n_grau_zero", "n_componentes", "maior_componente", "grau_maximo", "n_clientes_total")
