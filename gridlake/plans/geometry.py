"""Geometry end to end on the derived grid: its layers get WKB bytes, operators decode them again.

Feeders stand in rows of forty blocks, the nodes of one in a square of ten by five, about forty metres apart. An open
switch between two feeders stands up to three metres beside its far node; every tenth feeder lies in a substation's
yard; a part of the segments has no geometry. The same numbers define the places for Spark and for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.geo import box_bytes, box_edges, line_bytes, point_bytes
from gridlake.operators.inventory import feeder_inventory
from gridlake.operators.ties import detect_ties
from gridlake.plans.grid import _CUSTOMER, _OPEN, _plain, layers
from gridlake.plans.registry import ORACLES, query, table
from gridlake.sources.catalog import LayerCatalog


def _lon(c: str) -> str:
    return f"(-43.5 + CAST((CAST(floor({c} / 50) AS BIGINT) % 40) * 60 + (({c}) % 50 % 10) * 4 AS DOUBLE) / 10000.0)"


def _lat(c: str) -> str:
    return f"(-22.5 + CAST(CAST(floor(CAST(floor({c} / 50) AS BIGINT) / 40) AS BIGINT) * 40 + CAST(floor(({c}) % 50 / 10) AS BIGINT) * 4 AS DOUBLE) / 10000.0)"


PLACES = {
    "SSDMT": f"""SELECT concat('L', c) AS COD_ID, {_lon("parent")} AS x1, {_lat("parent")} AS y1, {_lon("c")} AS x2, {_lat("c")} AS y2
        FROM {{cust}} WHERE i > 1 AND seg NOT IN ('MACHINERY', 'HOUSEHOLD') AND c % 53 <> 0""",
    "UNSEMT": f"""SELECT concat('K', c) AS COD_ID, {_lon("c")} AS x, {_lat("c")} AS y FROM {{cust}}
        UNION ALL SELECT concat(CASE WHEN fa = fb THEN 'R' ELSE 'T' END, o), {_lon("cb")} + CAST(o % 97 AS DOUBLE) / 97.0 * 0.00003, {_lat("cb")} FROM {{opens}}""",
    "SUB": f"""SELECT concat('S', CAST(floor(f / 10) AS BIGINT)) AS COD_ID, {_lon("min(f) * 50")} - 0.0003 AS x1, {_lat("min(f) * 50")} - 0.0003 AS y1,
        {_lon("min(f) * 50")} + 0.0039 AS x2, {_lat("min(f) * 50")} + 0.0019 AS y2 FROM {{cust}} GROUP BY 1""",
}
#: West, south, east and north of the area the inventory is asked for: the first twenty blocks of each row.
AREA = (-43.501, -30.0, -43.3815, -20.0)


def _statement(name: str) -> str:
    return PLACES[name].replace("{cust}", f"({_CUSTOMER}) cu").replace("{opens}", f"({_OPEN}) op")


def shaped_layers(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The derived layers, three of them with a WKB ``geometry``."""
    out = layers(spark, sf)
    tables = {n: table(spark, sf, n) for n in ("customer", "orders")}
    bytes_of = {"SSDMT": line_bytes("x1", "y1", "x2", "y2"), "UNSEMT": point_bytes("x", "y"), "SUB": box_bytes("x1", "y1", "x2", "y2")}
    for name, geometry in bytes_of.items():
        text = _statement(name)
        places = spark.sql(text, **{n: df for n, df in tables.items() if f"{{{n}}}" in text}).select("COD_ID", geometry.alias("geometry"))
        out[name] = out[name].join(places, "COD_ID", "left")
    return out


def _utm(prefix: str, lon: str, lat: str) -> str:
    """Columns of transverse Mercator metres by the series in the third flattening."""
    n = "((1.0 / 298.257222101) / (2.0 - 1.0 / 298.257222101))"
    e = f"(2.0 * sqrt({n}) / (1.0 + {n}))"
    t = f"sinh(atanh(sin(radians({lat}))) - {e} * atanh({e} * sin(radians({lat}))))"
    lam = f"radians({lon} + 45.0)"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1.0 + {t} * {t}))"
    alphas = (f"({n} / 2 - 2 * pow({n}, 2) / 3 + 5 * pow({n}, 3) / 16)", f"(13 * pow({n}, 2) / 48 - 3 * pow({n}, 3) / 5)", f"(61 * pow({n}, 3) / 240)")
    scale = f"0.9996 * 6378137.0 / (1 + {n}) * (1 + pow({n}, 2) / 4 + pow({n}, 4) / 64)"
    east = " + ".join([eta, *(f"{a} * cos(2 * {j} * {xi}) * sinh(2 * {j} * {eta})" for j, a in enumerate(alphas, 1))])
    north = " + ".join([xi, *(f"{a} * sin(2 * {j} * {xi}) * cosh(2 * {j} * {eta})" for j, a in enumerate(alphas, 1))])
    return f"500000.0 + {scale} * ({east}) AS {prefix}x, 10000000.0 + {scale} * ({north}) AS {prefix}y"


def _place(name: str) -> str:
    return _statement(name).replace("{", "").replace("}", "")


_BASE = "CTMT", "SSDMT", "UNSEMT", "SUB"
_DETECT = f"""
  pseg AS MATERIALIZED ({_place("SSDMT")}), psw AS MATERIALIZED ({_place("UNSEMT")}), psub AS MATERIALIZED ({_place("SUB")}),
  en AS (SELECT s.COD_ID AS id, s.CTMT AS f, s.PAC_1 AS n, p.x1 AS lon, p.y1 AS lat FROM ssdmt s JOIN pseg p USING (COD_ID)
         UNION ALL SELECT s.COD_ID, s.CTMT, s.PAC_2, p.x2, p.y2 FROM ssdmt s JOIN pseg p USING (COD_ID)),
  eu AS MATERIALIZED (SELECT *, {_utm("", "lon", "lat")} FROM en),
  pu AS MATERIALIZED (SELECT s.COD_ID, s.CTMT, s.P_N_OPE, s.TLCD, s.TIP_UNID, p.x AS lon, p.y AS lat, {_utm("u", "p.x", "p.y")} FROM unsemt s JOIN psw p USING (COD_ID) WHERE s.P_N_OPE = 'A'),
  sides AS (SELECT COD_ID AS k, unnest([{{'a': x1, 'b': y1, 'c': x2, 'd': y1}}, {{'a': x2, 'b': y1, 'c': x2, 'd': y2}}, {{'a': x2, 'b': y2, 'c': x1, 'd': y2}}, {{'a': x1, 'b': y2, 'c': x1, 'd': y1}}]) AS e FROM psub),
  su AS MATERIALIZED (SELECT k, {_utm("s", "e.a", "e.b")}, {_utm("t", "e.c", "e.d")} FROM sides),
  near AS (SELECT p.*, e.f AS viz, e.id AS seg, e.n AS pac, sqrt((p.ux - e.x) * (p.ux - e.x) + (p.uy - e.y) * (p.uy - e.y)) AS d
           FROM pu p JOIN eu e ON abs(p.lon - e.lon) < 0.0001 AND abs(p.lat - e.lat) < 0.0001 AND e.f <> p.CTMT),
  best AS (SELECT *, row_number() OVER (PARTITION BY COD_ID, viz ORDER BY d, seg, pac) AS r FROM near WHERE d <= 2.0),
  gap AS (SELECT b.COD_ID, su.k, min(sqrt(pow(b.ux - (sx + u * (tx - sx)), 2) + pow(b.uy - (sy + u * (ty - sy)), 2))) AS d
          FROM (SELECT DISTINCT COD_ID, ux, uy FROM best) b, su, LATERAL (SELECT greatest(0.0, least(1.0, ((b.ux - sx) * (tx - sx) + (b.uy - sy) * (ty - sy)) / (pow(tx - sx, 2) + pow(ty - sy, 2)))) AS u) l
          GROUP BY 1, 2),
  yard AS (SELECT COD_ID FROM gap WHERE d <= 50 UNION SELECT b.COD_ID FROM best b JOIN psub s ON b.lon BETWEEN s.x1 AND s.x2 AND b.lat BETWEEN s.y1 AND s.y2),
  found AS MATERIALIZED (SELECT COD_ID, CTMT, viz AS CTMT_VIZ, seg AS SSDMT_VIZ, pac AS PAC_VIZ, round_even(d * 1000, 0) / 1000 AS DIST_M, P_N_OPE, TLCD, TIP_UNID,
           COD_ID IN (SELECT COD_ID FROM yard) AS EM_SUB, lon, lat FROM best WHERE r = 1)
"""


def _ctes(*names: str) -> str:
    return ",\n".join(f"{n.lower()} AS MATERIALIZED ({_plain(n)})" for n in names)


@query("tie_detection", f"WITH {_ctes(*_BASE)},{_DETECT}SELECT * FROM found")
def tie_detection(spark: SparkSession, sf: str) -> DataFrame:
    """From geometry bytes to ties with their yard flag."""
    lay = shaped_layers(spark, sf)
    return detect_ties(lay["UNSEMT"], lay["SSDMT"], lay["SUB"])


def _inventory_sql() -> str:
    """The inventory's oracle over detected ties, with extents, for the feeders that touch the area."""
    west, south, east, north = AREA
    text = ORACLES["entity_inventory"].split("\n  tm AS", 1)[1]
    for old, new in (
        ("(SELECT COD_ID, CTMT FROM untrmt)", "(SELECT COD_ID, CTMT FROM untrmt WHERE CTMT IN (SELECT CTMT FROM touched))"),
        ("EM_SUB FROM interligacoes UNION ALL", "EM_SUB FROM found UNION ALL"), ("EM_SUB FROM interligacoes)", "EM_SUB FROM found)"),
        ("CAST(NULL AS DOUBLE) AS lon_min, CAST(NULL AS DOUBLE) AS lat_min, CAST(NULL AS DOUBLE) AS lon_max, CAST(NULL AS DOUBLE) AS lat_max", "ex.lon_min, ex.lat_min, ex.lon_max, ex.lat_max"),
        ("FROM ctmt f LEFT JOIN", "FROM ctmt f JOIN touched ON touched.CTMT = f.COD_ID LEFT JOIN ex ON ex.f = f.COD_ID LEFT JOIN"),
    ):
        if text.count(old) != 1:
            raise ValueError(f"the inventory's statement has changed: {old}")
        text = text.replace(old, new)
    extra = f"""
  touched AS (SELECT DISTINCT f AS CTMT FROM en WHERE lon BETWEEN {west} AND {east} AND lat BETWEEN {south} AND {north}),
  ex AS (SELECT f, {", ".join(f"round_even({how}({c}) * 1000000, 0) / 1000000 AS {c}_{how}" for how in ("min", "max") for c in ("lon", "lat"))} FROM en GROUP BY 1)"""
    names = (*_BASE, "UNTRMT", "UCBT_tab", "UCMT_tab", "UGBT_tab", "UGMT_tab")
    return f"WITH {_ctes(*names)},{_DETECT},{extra},\n  tm AS{text}"


@query("area_inventory", _inventory_sql())
def area_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A8, J7 and all of the inventory's parts: extents, detected ties, feeders that touch an area."""
    west, south, east, north = (F.lit(v) for v in AREA)
    area = spark.range(1).select(
        F.lit("asked").alias("area_id"), box_edges(west, south, east, north).alias("edges"), west.alias("minx"), south.alias("miny"), east.alias("maxx"), north.alias("maxy"))
    return feeder_inventory(LayerCatalog.of(spark, shaped_layers(spark, sf)), area=area, area_cell=0.1)
