"""Inventory, spatial and tie operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.columns import round_to
from gridlake.functions.geo import box_edges
from gridlake.functions.keyed import mode_per_key, unique_mode_per_key
from gridlake.operators import spatial
from gridlake.operators.inventory import customers_by_feeder
from gridlake.operators.recon import weighted_mode
from gridlake.operators.sample import REFERENCES
from gridlake.operators.ties import neighbours, symmetric_counts
from gridlake.plans.registry import query, table


@query(
    "effective_key_rollup",
    """
    SELECT CASE WHEN p.p_size <= 25 THEN p.p_brand ELSE l.l_returnflag END AS CTMT,
           count(*) AS n,
           CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS kwh
    FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1
    """,
)
def effective_key_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """P5, A3: a line's key is the brand of a small part, else its own flag."""
    mapping = table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("COD_ID"), F.col("p_brand").alias("CTMT"))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("UNI_TR_MT"), F.col("l_returnflag").alias("CTMT"), F.col("l_quantity").alias("ENE_01")
    )
    return customers_by_feeder(rows, mapping)


@query(
    "mode_per_group",
    """
    SELECT o_custkey, o_orderpriority AS moda FROM (
      SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r
      FROM orders GROUP BY 1, 2) WHERE r = 1
    """,
)
def mode_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """A5."""
    return mode_per_key(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", out="moda")


@query(
    "weighted_mode",
    """
    SELECT o_custkey, o_orderpriority AS moda FROM (
      SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey
        ORDER BY sum(CAST(o_totalprice AS DECIMAL(28,6))) DESC, o_orderpriority) AS r
      FROM orders GROUP BY 1, 2) WHERE r = 1
    """,
)
def weighted_mode_query(spark: SparkSession, sf: str) -> DataFrame:
    """A7."""
    return weighted_mode(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_totalprice", "moda")


@query(
    "unique_mode",
    """
    WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
         m AS (SELECT *, max(n) OVER (PARTITION BY o_custkey) AS best FROM c)
    SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(o_orderpriority) END AS moda
    FROM m WHERE n = best GROUP BY 1
    """,
)
def unique_mode(spark: SparkSession, sf: str) -> DataFrame:
    """A6."""
    return unique_mode_per_key(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "moda")


# --- embeddings as points, lines and areas -------------------------------------------------------

RADIUS = 0.02
_POINTS = """
  pts AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
                 CAST(embedding[3] AS DOUBLE) AS x2, CAST(embedding[4] AS DOUBLE) AS y2 FROM embeddings),
  ends AS (SELECT vec_id, label, x, y, 1 AS pac FROM pts UNION ALL SELECT vec_id, label, x2, y2, 2 FROM pts)
"""
_PAIRS = f"""
  cand AS (SELECT p.vec_id AS cod, p.label AS ctmt, e.label AS viz, e.vec_id AS seg, e.pac,
                  sqrt((p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y)) AS d
           FROM pts p JOIN ends e ON e.label <> p.label AND abs(p.x - e.x) <= {RADIUS} AND abs(p.y - e.y) <= {RADIUS}),
  pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cod, viz ORDER BY d, seg, pac) AS r
            FROM cand WHERE d <= {RADIUS}) WHERE r = 1)
"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", *[e[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "x2", "y2"))]
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector is a switch at (x, y) and a segment with ends (x, y) and (x2, y2); label = feeder."""
    p = points(spark, sf)
    switches = p.select(F.col("vec_id").alias("COD_ID"), F.col("label").alias("CTMT"), "x", "y")
    ends = p.select(
        F.col("vec_id").alias("SSDMT_VIZ"), F.col("label").alias("CTMT_VIZ"),
        F.explode(F.array(F.struct(F.lit(1).alias("PAC_VIZ"), "x", "y"), F.struct(F.lit(2).alias("PAC_VIZ"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e"),
    ).select("SSDMT_VIZ", "CTMT_VIZ", "e.*")
    return spatial.proximity_pairs(switches, ends, RADIUS)


@query(
    "proximity_pairs",
    f"""
    WITH {_POINTS}, {_PAIRS}
    SELECT cod AS COD_ID, ctmt AS CTMT, viz AS CTMT_VIZ, seg AS SSDMT_VIZ, pac AS PAC_VIZ, round_even(d * 1000000, 0) / 1000000 AS DIST_M FROM pairs
    """,
)
def proximity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """G2, J5, W1."""
    return pairs(spark, sf).select("COD_ID", "CTMT", "CTMT_VIZ", "SSDMT_VIZ", "PAC_VIZ", round_to(F.col("DIST_M"), 6).alias("DIST_M"))


def tie_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs as ties: remote when the nearest end is a last vertex, in a yard when very near."""
    return pairs(spark, sf).select(
        "COD_ID", "CTMT", "CTMT_VIZ", F.when(F.col("PAC_VIZ") == 2, 1).otherwise(0).alias("TLCD"), (F.col("DIST_M") <= 0.008).alias("EM_SUB")
    )


_TIES = f"WITH {_POINTS}, {_PAIRS}, t AS (SELECT cod, ctmt, viz, CASE WHEN pac = 2 THEN 1 ELSE 0 END AS tlcd, d <= 0.008 AS em_sub FROM pairs), s AS (SELECT cod, ctmt, viz, tlcd, em_sub, true AS dono FROM t UNION ALL SELECT cod, viz, ctmt, tlcd, em_sub, false FROM t)"


@query(
    "symmetric_counts",
    _TIES
    + """
    SELECT ctmt AS CTMT, count(DISTINCT cod) AS NA_interligacao,
           count(DISTINCT CASE WHEN tlcd = 1 THEN cod END) AS NA_interligacao_telecomandada,
           count(DISTINCT CASE WHEN em_sub THEN cod END) AS NA_interligacao_SE,
           count(DISTINCT CASE WHEN NOT em_sub THEN cod END) AS NA_interligacao_campo,
           count(DISTINCT CASE WHEN NOT em_sub AND tlcd = 1 THEN cod END) AS NA_interligacao_campo_telecomandada,
           count(DISTINCT viz) AS n_vizinhos,
           string_agg(DISTINCT CAST(viz AS VARCHAR), ';' ORDER BY CAST(viz AS VARCHAR)) AS vizinhos
    FROM s GROUP BY 1
    """,
)
def symmetric_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    """A9, U3."""
    ties = tie_rows(spark, sf)
    rows = ties.withColumns({"CTMT": F.col("CTMT").cast("string"), "CTMT_VIZ": F.col("CTMT_VIZ").cast("string")})
    return symmetric_counts(rows).withColumn("CTMT", F.col("CTMT").cast("int"))


@query(
    "neighbours",
    _TIES
    + """,
    u AS (SELECT ctmt, viz, cod, arg_max(tlcd, dono) AS tlcd, arg_max(em_sub, dono) AS em_sub, max(dono) AS dono FROM s GROUP BY 1, 2, 3)
    SELECT ctmt AS CTMT, viz AS CTMT_VIZ, count(*) FILTER (NOT em_sub) AS ties,
           count(*) FILTER (NOT em_sub AND tlcd = 1) AS ties_telecomandadas,
           count(*) FILTER (NOT em_sub) - count(*) FILTER (NOT em_sub AND tlcd = 1) AS ties_manuais,
           count(*) FILTER (em_sub) AS ties_em_SE,
           count(*) FILTER (NOT em_sub AND dono) AS ties_proprias,
           count(*) FILTER (NOT em_sub) - count(*) FILTER (NOT em_sub AND dono) AS ties_do_vizinho,
           coalesce(string_agg(CAST(cod AS VARCHAR), ';' ORDER BY CAST(cod AS VARCHAR)) FILTER (NOT em_sub), '') AS chaves
    FROM u GROUP BY 1, 2
    """,
)
def neighbours_query(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    return neighbours(tie_rows(spark, sf), without_yard=True)


_BOXES = """
  boxes AS (SELECT label AS box, min(x) AS x1, min(y) AS y1, min(x) + (max(x) - min(x)) / 8 AS x2, min(y) + (max(y) - min(y)) / 8 AS y2 FROM pts GROUP BY 1)
"""


def label_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Lower-left corner of each label's extent as a polygon."""
    boxes = points(spark, sf).groupBy("label").agg(
        F.min("x").alias("minx"), F.min("y").alias("miny"),
        (F.min("x") + (F.max("x") - F.min("x")) / 8).alias("maxx"), (F.min("y") + (F.max("y") - F.min("y")) / 8).alias("maxy"),
    )
    return boxes.withColumn("edges", box_edges(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))


@query(
    "near_polygon_flag",
    f"""
    WITH {_POINTS}, {_BOXES},
      d AS (SELECT vec_id, box, sqrt(power(greatest(b.x1 - p.x, 0, p.x - b.x2), 2) + power(greatest(b.y1 - p.y, 0, p.y - b.y2), 2)) AS d FROM pts p, boxes b)
    SELECT vec_id, box AS polygon_id, round_even(d * 1000000, 0) / 1000000 AS distance FROM d WHERE d <= 0.01
    """,
)
def near_polygon_flag(spark: SparkSession, sf: str) -> DataFrame:
    """J6."""
    boxes = label_boxes(spark, sf).withColumnRenamed("label", "polygon_id")
    found = spatial.points_near_polygons(points(spark, sf).select("vec_id", "x", "y"), boxes, 0.01, cell=0.1)
    return found.select("vec_id", "polygon_id", round_to(F.col("distance"), 6).alias("distance"))


@query(
    "points_in_area",
    f"""
    WITH {_POINTS}, {_BOXES},
      hit AS (
        SELECT p.label, b.box FROM pts p JOIN boxes b
          ON least(p.x, p.x2) <= b.x2 AND greatest(p.x, p.x2) >= b.x1 AND least(p.y, p.y2) <= b.y2 AND greatest(p.y, p.y2) >= b.y1
         AND greatest((p.x2 - p.x) * (b.y1 - p.y) - (p.y2 - p.y) * (b.x1 - p.x), (p.x2 - p.x) * (b.y1 - p.y) - (p.y2 - p.y) * (b.x2 - p.x),
                      (p.x2 - p.x) * (b.y2 - p.y) - (p.y2 - p.y) * (b.x1 - p.x), (p.x2 - p.x) * (b.y2 - p.y) - (p.y2 - p.y) * (b.x2 - p.x)) >= 0
         AND least((p.x2 - p.x) * (b.y1 - p.y) - (p.y2 - p.y) * (b.x1 - p.x), (p.x2 - p.x) * (b.y1 - p.y) - (p.y2 - p.y) * (b.x2 - p.x),
                   (p.x2 - p.x) * (b.y2 - p.y) - (p.y2 - p.y) * (b.x1 - p.x), (p.x2 - p.x) * (b.y2 - p.y) - (p.y2 - p.y) * (b.x2 - p.x)) <= 0)
    SELECT DISTINCT label AS CTMT, box AS area_id FROM hit
    """,
)
def points_in_area(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with a segment that touches another label's area."""
    p = points(spark, sf)
    lines = p.select(
        F.col("label").alias("CTMT"), F.array(F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")).alias("edges"),
        F.least("x", "x2").alias("minx"), F.least("y", "y2").alias("miny"), F.greatest("x", "x2").alias("maxx"), F.greatest("y", "y2").alias("maxy"),
    )
    return spatial.lines_meeting_areas(lines, label_boxes(spark, sf).withColumnRenamed("label", "area_id"), cell=0.1)


_REFERENCE_ROWS = ", ".join(f"({i}, '{n}', {a}, {b}, {r})" for i, (n, a, b, r) in enumerate(REFERENCES))


@query(
    "nearest_reference",
    f"""
    WITH {_POINTS},
      refs AS (SELECT * FROM (VALUES {_REFERENCE_ROWS}) AS v(i, nome, la, lo, raio)),
      d AS (SELECT vec_id, i, nome, raio,
                   sqrt(power((la - (y - 22.94)) * 111.32, 2) + power((lo - (x - 43.25)) * 111.32 * cos(radians((y - 22.94 + la) / 2)), 2)) AS d
            FROM pts, refs),
      best AS (SELECT vec_id, nome, row_number() OVER (PARTITION BY vec_id ORDER BY d, i) AS r FROM d WHERE d <= raio)
    SELECT p.vec_id, b.nome AS regiao FROM pts p LEFT JOIN best b ON b.vec_id = p.vec_id AND b.r = 1
    """,
)
def nearest_reference_query(spark: SparkSession, sf: str) -> DataFrame:
    """J8, F2."""
    return spatial.nearest_reference(
        points(spark, sf), REFERENCES, lat=F.col("y") - 22.94, lon=F.col("x") - 43.25, out="regiao"
    ).select("vec_id", "regiao")


@query(
    "extent_per_label",
    f"""
    WITH {_POINTS}
    SELECT label, round_even(min(least(x, x2)) * 1000000, 0) / 1000000 AS lon_min, round_even(min(least(y, y2)) * 1000000, 0) / 1000000 AS lat_min,
           round_even(max(greatest(x, x2)) * 1000000, 0) / 1000000 AS lon_max, round_even(max(greatest(y, y2)) * 1000000, 0) / 1000000 AS lat_max
    FROM pts GROUP BY 1
    """,
)
def extent_per_label(spark: SparkSession, sf: str) -> DataFrame:
    """A8."""
    p = points(spark, sf).select(
        "label", F.least("x", "x2").alias("minx"), F.least("y", "y2").alias("miny"), F.greatest("x", "x2").alias("maxx"), F.greatest("y", "y2").alias("maxy")
    )
    return spatial.extent_per_key(p, ["label"])


@query(
    "extent_filter",
    f"""
    WITH {_POINTS},
      e AS (SELECT label, (min(x2) + max(x2)) / 2 AS cx, (min(y2) + max(y2)) / 2 AS cy, (max(x2) - min(x2)) / 4 AS w, (max(y2) - min(y2)) / 4 AS h FROM pts GROUP BY 1),
      b AS (SELECT label, cx - w AS x1, cx + w AS x2, cy - h AS y1, cy + h AS y2 FROM e),
      m AS (SELECT *, 500.0 / (111320.0 * greatest(cos(radians((y1 + y2) / 2)), 0.01)) AS dx, 500.0 / 111320.0 AS dy FROM b)
    SELECT p.vec_id, p.label, (p.x >= m.x1 - dx AND p.x <= m.x2 + dx AND p.y >= m.y1 - dy AND p.y <= m.y2 + dy) AS inside
    FROM pts p JOIN m ON m.label = p.label
    """,
)
def extent_filter_query(spark: SparkSession, sf: str) -> DataFrame:
    """Points against the middle half of their label's second extent, 500 m margin."""
    p = points(spark, sf)
    mid = p.groupBy("label").agg(
        ((F.min("x2") + F.max("x2")) / 2).alias("cx"), ((F.min("y2") + F.max("y2")) / 2).alias("cy"),
        ((F.max("x2") - F.min("x2")) / 4).alias("w"), ((F.max("y2") - F.min("y2")) / 4).alias("h"),
    ).selectExpr("label", "cx - w AS lon_min", "cx + w AS lon_max", "cy - h AS lat_min", "cy + h AS lat_max")
    return spatial.extent_filter(p, mid, ["label"], 500.0).select("vec_id", "label", "inside")


# --- references measured against positions -------------------------------------------------------

_POSITIONS = """
  poles AS (SELECT p_partkey AS id, -43.0 - p_retailprice / 100000.0 AS x, -22.5 - p_size / 1000.0 AS y FROM part),
  trafos AS (SELECT s_suppkey AS id, -43.0 - (s_acctbal + 1000.0) / 500000.0 AS x, -22.5 - s_nationkey / 500.0 AS y FROM supplier),
  refs AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'),
  far AS (SELECT l_partkey, l_suppkey, sqrt(power(6378137.0 * radians(p.x - t.x), 2)
             + power(6378137.0 * (ln(tan(pi() / 4 + radians(p.y) / 2)) - ln(tan(pi() / 4 + radians(t.y) / 2))), 2)) AS d
          FROM refs JOIN poles p ON p.id = l_partkey JOIN trafos t ON t.id = l_suppkey)
"""


def _positions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    poles = table(spark, sf, "part").selectExpr("p_partkey AS COD_ID", "-43.0D - p_retailprice / 100000.0D AS x", "-22.5D - p_size / 1000.0D AS y")
    trafos = table(spark, sf, "supplier").selectExpr("s_suppkey AS COD_ID", "-43.0D - (s_acctbal + 1000.0D) / 500000.0D AS x", "-22.5D - s_nationkey / 500.0D AS y")
    refs = table(spark, sf, "lineitem").selectExpr("l_partkey AS PN_CON", "l_suppkey AS UNI_TR_MT", "l_returnflag")
    return poles, trafos, refs


@query(
    "far_references",
    f"""
    WITH {_POSITIONS}
    SELECT l_suppkey AS UNI_TR_MT, count(*) AS medidas, count(*) FILTER (d > 2000) AS longe, round_even(max(d) * 1000, 0) / 1000 AS pior FROM far GROUP BY 1
    """,
)
def far_references_query(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (pole, transformer) references measured and compared with 2 km."""
    poles, trafos, refs = _positions(spark, sf)
    distinct = refs.where("l_returnflag <> 'R'").select("PN_CON", "UNI_TR_MT").distinct()
    measured = spatial.measured_references(distinct, poles, trafos)
    return measured.groupBy("UNI_TR_MT").agg(
        F.count("dist_m").alias("medidas"), F.count_if(F.col("dist_m") > 2000).alias("longe"), round_to(F.max("dist_m"), 3).alias("pior")
    )


@query(
    "reference_distance_filter",
    f"""
    WITH {_POSITIONS},
      others AS (SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 15),
      per AS (SELECT l_partkey AS id, max(d <= 2000) AS near, max(d > 2000) AS far FROM far GROUP BY 1),
      f AS (SELECT p.id, coalesce(per.far, false) AND o.id IS NULL AS too_far, o.id IS NOT NULL OR coalesce(per.near, false) AS valid
            FROM poles p LEFT JOIN per ON per.id = p.id LEFT JOIN others o ON o.id = p.id)
    SELECT id AS COD_ID, too_far, (NOT (SELECT max(too_far) FROM f)) OR valid AS keep FROM f
    """,
)
def reference_distance_filter(spark: SparkSession, sf: str) -> DataFrame:
    """P10: parts as poles; parts often returned count as referenced by another layer."""
    poles, trafos, refs = _positions(spark, sf)
    others = refs.where("l_returnflag = 'R'").groupBy("PN_CON").count().where("count >= 15").select("PN_CON")
    return spatial.poles_to_keep(poles, refs.where("l_returnflag <> 'R'"), others, trafos).select("COD_ID", "too_far", "keep")
