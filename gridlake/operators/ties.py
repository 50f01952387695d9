"""Ties: normally-open switches that geometrically reach another feeder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.columns import number, round_to
from gridlake.functions.geo import part_ends, with_shape, with_utm
from gridlake.operators.spatial import points_near_polygons, proximity_pairs

RADIUS_M = 2.0
YARD_M = 50.0
TIE_COLUMNS = [
    "COD_ID", "CTMT", "CTMT_VIZ", "SSDMT_VIZ", "PAC_VIZ", "DIST_M", "P_N_OPE", "TLCD", "TIP_UNID",
    "EM_SUB", "lon", "lat",
]


def segment_ends(segments: DataFrame, project: bool = True, central_meridian: float = -45.0) -> DataFrame:
    """One row per line-part end: segment, feeder, node (PAC_1 first, PAC_2 last), x, y."""
    shaped = with_shape(segments.select("COD_ID", "CTMT", "PAC_1", "PAC_2", "geometry")).drop("geometry")
    ends = part_ends(shaped)
    node = F.when(F.col("end") == 1, F.col("PAC_1")).otherwise(F.col("PAC_2"))
    named = ends.select(
        F.col("COD_ID").alias("SSDMT_VIZ"), F.col("CTMT").alias("CTMT_VIZ"), node.alias("PAC_VIZ"), "x", "y"
    )
    return with_utm(named, F.col("x"), F.col("y"), central_meridian=central_meridian) if project else named


def detect_ties(
    switches: DataFrame,
    segments: DataFrame,
    substations: DataFrame | None = None,
    *,
    radius_m: float = RADIUS_M,
    yard_m: float = YARD_M,
    only_open: bool = True,
    central_meridian: float = -45.0,
) -> DataFrame:
    """One row per (switch, neighbouring feeder) with the nearest segment end (G3 = J5 + J6).

    Inputs carry WKB ``geometry`` in degrees; distances are metres in the UTM zone of
    ``central_meridian``. The distance is rounded to 3 places after the nearest end is chosen.
    """
    chosen = switches
    if only_open and "P_N_OPE" in switches.columns:
        chosen = switches.where(F.col("P_N_OPE") == "A")
    for c in ("P_N_OPE", "TLCD", "TIP_UNID"):
        if c not in chosen.columns:
            chosen = chosen.withColumn(c, F.lit(None).cast("string"))
    points = with_shape(
        chosen.select("COD_ID", "CTMT", "P_N_OPE", "TLCD", "TIP_UNID", "geometry")
    ).where(F.col("shape.minx").isNotNull())
    points = points.select(
        "COD_ID", "CTMT", "P_N_OPE", "TLCD", "TIP_UNID", F.col("shape.minx").alias("lon"), F.col("shape.miny").alias("lat")
    )
    points = with_utm(points, F.col("lon"), F.col("lat"), central_meridian=central_meridian)
    pairs = proximity_pairs(points, segment_ends(segments, central_meridian=central_meridian), radius_m)
    if substations is None:
        pairs = pairs.withColumn("EM_SUB", F.lit(False))
    else:
        yards = substation_polygons(substations, central_meridian)
        touched = (
            points_near_polygons(
                pairs.select("COD_ID", "x", "y").distinct(), yards, yard_m, cell=max(200.0, 4 * yard_m)
            )
            .select("COD_ID")
            .distinct()
            .withColumn("EM_SUB", F.lit(True))
        )
        pairs = pairs.join(touched, "COD_ID", "left").withColumn(
            "EM_SUB", F.coalesce(F.col("EM_SUB"), F.lit(False))
        )
    return pairs.withColumn("DIST_M", round_to(F.col("DIST_M"), 3)).withColumn(
        "TLCD", F.coalesce(number(F.col("TLCD")).cast("int"), F.lit(0))
    ).select(*TIE_COLUMNS)


def substation_polygons(substations: DataFrame, central_meridian: float = -45.0) -> DataFrame:
    """Substation polygons in metres: id, edge array, extent."""
    shaped = with_shape(substations.select("COD_ID", "geometry")).where(F.size("shape.edges") > 0)
    sides = shaped.select(F.col("COD_ID").alias("polygon_id"), F.posexplode("shape.edges").alias("at", "e"))
    start = with_utm(sides, F.col("e.x1"), F.col("e.y1"), x="x1", y="y1", central_meridian=central_meridian)
    both = with_utm(start, F.col("e.x2"), F.col("e.y2"), x="x2", y="y2", central_meridian=central_meridian)
    # the edges of one polygon: bounded by its own outline
    return both.groupBy("polygon_id").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"),
        F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"),
        F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"),
    )


def both_directions(
    ties: DataFrame, extra: Sequence[str] = ("COD_ID", "TLCD", "EM_SUB"),
    a: str = "CTMT", b: str = "CTMT_VIZ",
) -> DataFrame:
    """Each tie seen from both feeders; ``DONO`` marks the owner's side.

    One scan: each row is exploded into its two directions.
    """
    sides = F.array(
        F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(True).alias("own")),
        F.struct(F.col(b).alias("a"), F.col(a).alias("b"), F.lit(False).alias("own")),
    )
    return ties.select(*extra, F.explode(sides).alias("_s")).select(
        F.col("_s.a").alias(a), F.col("_s.b").alias(b), *extra, F.col("_s.own").alias("DONO")
    )


def symmetric_counts(ties: DataFrame) -> DataFrame:
    """Distinct switches per feeder, seen from both sides, by kind; neighbours and their list.

    Two levels of aggregation: first one row per (feeder, switch), then counts; the neighbour list
    is built from distinct (feeder, neighbour) rows.
    """
    pairs = both_directions(ties)
    remote = F.coalesce(F.col("TLCD") == 1, F.lit(False))
    per_switch = pairs.groupBy("CTMT", "COD_ID").agg(
        F.max(remote).alias("remote"),
        F.max(F.col("EM_SUB")).alias("yard"),
        F.max(~F.col("EM_SUB")).alias("field"),
        F.max(~F.col("EM_SUB") & remote).alias("field_remote"),
    )
    counts = per_switch.groupBy("CTMT").agg(
        F.count(F.lit(1)).alias("NA_interligacao"),
        F.count_if("remote").alias("NA_interligacao_telecomandada"),
        F.count_if("yard").alias("NA_interligacao_SE"),
        F.count_if("field").alias("NA_interligacao_campo"),
        F.count_if("field_remote").alias("NA_interligacao_campo_telecomandada"),
    )
    neighbours = (
        pairs.select("CTMT", "CTMT_VIZ").distinct().groupBy("CTMT").agg(
            F.count(F.lit(1)).alias("n_vizinhos"),
            F.array_join(F.array_sort(F.collect_list("CTMT_VIZ")), ";").alias("vizinhos"),
        )
    )
    return counts.join(neighbours, "CTMT")


def neighbours(ties: DataFrame, *, without_yard: bool = False) -> DataFrame:
    """Neighbour table of every feeder at once; filter on ``CTMT`` for one feeder (A10).

    Counts (switch, neighbour) pairs. With ``without_yard`` in-substation switches leave every
    count but ``ties_em_SE``; a neighbour reached only through them stays with zero ties.
    """
    pairs = both_directions(ties)
    # the same switch may be listed from both sides: the owner's row wins
    unique = pairs.groupBy("CTMT", "CTMT_VIZ", "COD_ID").agg(
        F.max_by(F.struct("TLCD", "EM_SUB", "DONO"), "DONO").alias("_r")
    ).select("CTMT", "CTMT_VIZ", "COD_ID", "_r.*")
    counted = ~F.col("EM_SUB") if without_yard else F.lit(True)
    remote = counted & F.coalesce(F.col("TLCD") == 1, F.lit(False))
    return (
        unique.groupBy("CTMT", "CTMT_VIZ")
        .agg(
            F.count_if(counted).alias("ties"),
            F.count_if(remote).alias("ties_telecomandadas"),
            F.count_if(F.col("EM_SUB")).alias("ties_em_SE"),
            F.count_if(counted & F.col("DONO")).alias("ties_proprias"),
            F.array_join(
                F.array_sort(F.collect_list(F.when(counted, F.col("COD_ID").cast("string")))), ";"
            ).alias("chaves"),
        )
        .withColumn("ties_manuais", F.col("ties") - F.col("ties_telecomandadas"))
        .withColumn("ties_do_vizinho", F.col("ties") - F.col("ties_proprias"))
        .select(
            "CTMT", "CTMT_VIZ", "ties", "ties_telecomandadas", "ties_manuais", "ties_em_SE",
            "ties_proprias", "ties_do_vizinho", "chaves",
        )
    )
