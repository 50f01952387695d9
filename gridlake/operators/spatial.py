"""Spatial joins and filters as equi-joins on grid cells.

No operator compares every point with every point: coordinates are bucketed, buckets are joined
with equality, and the exact test runs on the candidates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.columns import degrees_for_metres, distance_km, round_to, web_mercator
from gridlake.functions.geo import distance_to_edges, edges_meet
from gridlake.session import materialise


def proximity_pairs(
    points: DataFrame,
    ends: DataFrame,
    radius: float,
    *,
    point_id: str = "COD_ID",
    owner: str = "CTMT",
    end_id: str = "SSDMT_VIZ",
    end_owner: str = "CTMT_VIZ",
    end_node: str = "PAC_VIZ",
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Nearest end of each *other* owner within ``radius`` of each point (ops J5, W1).

    Points and ends that share a position are collapsed first (a stack of copies is compared once) and the
    point's own rows come back with an equi-join on position. Cells of halving width are tried, the finest first: a
    3x3 neighbourhood of cells holds every end within their width, so an end found within it is the nearest, and
    only the (place, owner) pairs without one go on to cells twice as wide, up to ``radius``. The finest width leaves
    about one to four ends of an owner in a cell, so in dense places a point is not compared with every end
    around it. One row per (point, end owner); ``DIST_M`` is the unrounded distance; equal distances go to the
    smaller end id, then node.
    """
    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).alias("_px"), F.col(y).alias("_py")
    ).distinct()
    # one representative end per (position, owner): the smallest (id, node)
    unique_ends = materialise(
        ends.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(end_owner).isNotNull())
        .groupBy(F.col(x).alias("_ex"), F.col(y).alias("_ey"), F.col(end_owner).alias("_eo"))
        .agg(F.min(F.struct(F.col(end_id).alias("i"), F.col(end_node).alias("n"))).alias("_e")),
        "ends",
    )
    radius = float(radius)
    halvings = _halvings(unique_ends, radius)
    if halvings:
        spots = materialise(spots, "spots")
    found = _nearest(spots, unique_ends, radius / 2**halvings, radius)
    if halvings:
        found = materialise(found, "near")
        # the owners with an end in the neighbourhood: what is not found yet has none so near
        owners = unique_ends.select("_eo", *_cell(F.col("_ex"), F.col("_ey"), radius)).distinct()
        around = owners.select(
            "_eo", F.explode(_around("_cx")).alias("_cx"), "_cy").select("_eo", "_cx", F.explode(_around("_cy")).alias("_cy")).distinct()
        todo = spots.select("*", *_cell(F.col("_px"), F.col("_py"), radius)).join(around, ["_cx", "_cy"]).select("_px", "_py", "_eo")
        last, parts = found, [found]
        for k in reversed(range(halvings)):
            todo = materialise(todo.join(last.select("_px", "_py", "_eo"), ["_px", "_py", "_eo"], "left_anti"), "todo")
            last = materialise(_nearest(todo, unique_ends, radius / 2**k, radius), "near")
            parts.append(last)
        found = reduce(DataFrame.unionByName, parts)
    back = points.withColumn("_px", F.col(x)).withColumn("_py", F.col(y))
    matched = back.join(found, ["_px", "_py"]).where(F.col(owner) != F.col("_eo"))
    return matched.select(
        *points.columns,
        F.col("_eo").alias(end_owner),
        F.col("_best.i").alias(end_id),
        F.col("_best.n").alias(end_node),
        F.col("_best.d").alias("DIST_M"),
    )


def _cell(x: Column, y: Column, size: float) -> list[Column]:
    return [F.floor(x / size).alias("_cx"), F.floor(y / size).alias("_cy")]


def _around(cell: str) -> Column:
    return F.array(*[F.col(cell) + i for i in (-1, 0, 1)])


def _halvings(ends: DataFrame, radius: float) -> int:
    """How often ``radius`` may be halved so that a cell still holds about one end of an owner it has."""
    held = ends.groupBy("_eo", *_cell(F.col("_ex"), F.col("_ey"), radius)).agg(F.count(F.lit(1)).cast("double").alias("n"))
    beside = held.agg(F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n")).first()[0] or 0.0
    return min(int(math.log(beside, 4)), 20) if beside >= 1 else 0


def _nearest(places: DataFrame, ends: DataFrame, width: float, radius: float) -> DataFrame:
    """_px, _py, _eo, _best (d, i, n): nearest end within ``width``; ``places`` may ask for one owner each."""
    keys = ["_cx", "_cy"] + (["_eo"] if "_eo" in places.columns else [])
    near = places.select("*", *_cell(F.col("_px"), F.col("_py"), width)).withColumn("_cx", F.explode(_around("_cx"))).withColumn("_cy", F.explode(_around("_cy")))
    # a hair less than the width of a finer cell: divisions are rounded
    limit = width if width == radius else width * (1 - 1e-9)
    # the ends are sent to their cells: a small table of places still meets many of them, in more than one task
    return (
        near.join(ends.select("*", *_cell(F.col("_ex"), F.col("_ey"), width)).hint("merge"), keys)
        .withColumn("_d", F.hypot(F.col("_px") - F.col("_ex"), F.col("_py") - F.col("_ey")))
        .where(F.col("_d") <= limit)
        .groupBy("_px", "_py", "_eo")
        .agg(F.min(F.struct(F.col("_d").alias("d"), F.col("_e.i").alias("i"), F.col("_e.n").alias("n"))).alias("_best"))
    )


def _cells(df: DataFrame, minx: Column, miny: Column, maxx: Column, maxy: Column, size: float) -> DataFrame:
    low = [F.floor(minx / size), F.floor(miny / size)]
    high = [F.floor(maxx / size), F.floor(maxy / size)]
    return (
        df.withColumn("_lx", low[0])
        .withColumn("_ly", low[1])
        .withColumn("_cx", F.explode(F.sequence(low[0], high[0])))
        .withColumn("_cy", F.explode(F.sequence(low[1], high[1])))
    )


def _cell_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equi-join on cells that emits each pair once: in the larger of the two lower-left cells."""
    right = right.withColumnRenamed("_lx", "_rlx").withColumnRenamed("_ly", "_rly")
    return left.join(right, ["_cx", "_cy"]).where(
        (F.col("_cx") == F.greatest("_lx", "_rlx")) & (F.col("_cy") == F.greatest("_ly", "_rly"))
    )


def points_near_polygons(
    points: DataFrame,
    polygons: DataFrame,
    distance: float,
    *,
    x: str = "x",
    y: str = "y",
    edges: str = "edges",
    polygon_id: str = "polygon_id",
    cell: float | None = None,
) -> DataFrame:
    """(point columns, polygon id, ``distance``) for points inside or within ``distance`` (op J6).

    ``polygons`` carries ``minx, miny, maxx, maxy`` and an edge array in the points' unit.
    """
    if not cell and distance <= 0:
        raise ValueError("give a cell size for a containment test")
    size = cell or distance * 4
    left = _cells(
        points.where(F.col(x).isNotNull() & F.col(y).isNotNull()),
        F.col(x), F.col(y), F.col(x), F.col(y), size,
    )
    margin = F.lit(float(distance))
    right = _cells(
        polygons.select(
            F.col(polygon_id).alias("_poly"), F.col(edges).alias("_edges"),
            "minx", "miny", "maxx", "maxy",
        ),
        F.col("minx") - margin, F.col("miny") - margin, F.col("maxx") + margin, F.col("maxy") + margin,
        size,
    ).drop("minx", "miny", "maxx", "maxy")
    return (
        _cell_join(left, right)
        .withColumn("distance", distance_to_edges(F.col(x), F.col(y), F.col("_edges")))
        .where(F.col("distance") <= distance)
        .select(*points.columns, F.col("_poly").alias(polygon_id), "distance")
    )


def lines_meeting_areas(
    lines: DataFrame,
    areas: DataFrame,
    *,
    key: str = "CTMT",
    edges: str = "edges",
    area_id: str = "area_id",
    cell: float,
) -> DataFrame:
    """Distinct (key, area) with at least one line touching the area (op J7).

    Both sides carry extents and edge arrays; candidates share a grid cell.
    """
    left = _cells(
        lines.select(key, F.col(edges).alias("_line"), "minx", "miny", "maxx", "maxy"),
        F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), cell,
    )
    right = _cells(
        areas.select(
            F.col(area_id).alias("_area"), F.col(edges).alias("_edges"),
            F.col("minx").alias("_ax1"), F.col("miny").alias("_ay1"),
            F.col("maxx").alias("_ax2"), F.col("maxy").alias("_ay2"),
        ),
        F.col("_ax1"), F.col("_ay1"), F.col("_ax2"), F.col("_ay2"), cell,
    )
    overlap = (
        (F.col("minx") <= F.col("_ax2")) & (F.col("maxx") >= F.col("_ax1"))
        & (F.col("miny") <= F.col("_ay2")) & (F.col("maxy") >= F.col("_ay1"))
    )
    return (
        _cell_join(left, right)
        .where(overlap)
        .where(edges_meet(F.col("_line"), F.col("_edges")))
        .select(key, F.col("_area").alias(area_id))
        .distinct()
    )


def nearest_reference(
    df: DataFrame,
    references: Sequence[tuple[str, float, float, float]],
    *,
    lat: Column,
    lon: Column,
    out: str = "region",
) -> DataFrame:
    """Closest reference point (name, lat, lon, radius km) whose own radius holds the row (op J8).

    The references are a short fixed list given by the caller, so they travel as an array literal
    inside the expression: no join at all. Outside every radius the result is null; equal
    distances keep the earlier reference.
    """
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"), F.lit(name).alias("name"), F.lit(float(a)).alias("lat"),
                F.lit(float(b)).alias("lon"), F.lit(float(r)).alias("radius"),
            )
            for i, (name, a, b, r) in enumerate(references)
        ]
    )
    measured = F.transform(
        table,
        lambda r: F.struct(
            distance_km(lat, lon, r.lat, r.lon).alias("d"), r["rank"].alias("rank"),
            r.radius.alias("radius"), r["name"].alias("name"),
        ),
    )
    best = F.array_min(F.filter(measured, lambda r: r.d <= r.radius))
    return df.withColumn(out, F.when(lat.isNotNull() & lon.isNotNull(), best["name"]))


def extent_per_key(
    df: DataFrame, keys: Sequence[str], *, minx="minx", miny="miny", maxx="maxx", maxy="maxy",
    places: int | None = 6, also: Sequence[Column] = (),
) -> DataFrame:
    """Extent of each key (op A8); ``also`` adds aggregates to the same pass."""
    out = df.groupBy(*keys).agg(
        F.min(minx).alias("lon_min"), F.min(miny).alias("lat_min"),
        F.max(maxx).alias("lon_max"), F.max(maxy).alias("lat_max"),
        *also,
    )
    if places is None:
        return out
    for c in ("lon_min", "lat_min", "lon_max", "lat_max"):
        out = out.withColumn(c, round_to(F.col(c), places))
    return out


def extent_filter(
    rows: DataFrame, extents: DataFrame, keys: Sequence[str], margin_m: float, *, x: str = "x", y: str = "y"
) -> DataFrame:
    """Flag rows outside their key's extent widened by ``margin_m`` metres (op P9).

    Adds ``inside``; rows without coordinates or without an extent stay inside.
    """
    dx, dy = degrees_for_metres((F.col("lat_min") + F.col("lat_max")) / 2, margin_m)
    boxes = extents.select(
        *keys, (F.col("lon_min") - dx).alias("_x1"), (F.col("lat_min") - dy).alias("_y1"),
        (F.col("lon_max") + dx).alias("_x2"), (F.col("lat_max") + dy).alias("_y2"),
    )
    test = F.col(x).between(F.col("_x1"), F.col("_x2")) & F.col(y).between(F.col("_y1"), F.col("_y2"))
    return (
        rows.join(boxes, list(keys), "left")
        .withColumn("inside", F.coalesce(test, F.lit(True)))
        .drop("_x1", "_y1", "_x2", "_y2")
    )


def planar_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Web-Mercator distance in metres between two lon/lat points."""
    ax, ay = web_mercator(lon1, lat1)
    bx, by = web_mercator(lon2, lat2)
    return F.hypot(ax - bx, ay - by)


def measured_references(
    references: DataFrame, targets: DataFrame, anchors: DataFrame,
    *, target: str = "PN_CON", anchor: str = "UNI_TR_MT", clip: Sequence[str] = (),
) -> DataFrame:
    """Join (target, anchor) references to both positions and measure them (ops J12, P10).

    ``targets`` / ``anchors``: ``COD_ID, x, y`` in degrees (plus the clip keys when given).
    ``dist_m`` is null when either position is missing.
    """
    t = targets.select(*clip, F.col("COD_ID").alias(target), F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    a = anchors.select(*clip, F.col("COD_ID").alias(anchor), F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    return (
        references.join(t, [*clip, target], "left")
        .join(a, [*clip, anchor], "left")
        .withColumn("dist_m", planar_distance(F.col("_tx"), F.col("_ty"), F.col("_ax"), F.col("_ay")))
        .drop("_tx", "_ty", "_ax", "_ay")
    )


def poles_to_keep(
    poles: DataFrame,
    customer_refs: DataFrame,
    other_refs: DataFrame,
    transformers: DataFrame,
    max_m: float = 2000.0,
    clip: Sequence[str] = (),
) -> DataFrame:
    """Flag poles to drop because a customer reference is too far from its transformer (op P10).

    A pole stays when another layer references it, when some customer reference cannot be measured,
    or when some measured reference is within ``max_m``. A clip without any offending pole is left
    unchanged; in a clip with one, only poles with a valid reason stay. Adds ``keep`` and
    ``too_far`` (the offending poles).
    """
    keys = [*clip, "PN_CON"]
    refs = customer_refs.select(*keys, "UNI_TR_MT").where(
        F.col("PN_CON").isNotNull() & F.col("UNI_TR_MT").isNotNull()
    ).distinct()
    measured = measured_references(refs, poles, transformers, clip=clip)
    per_pole = measured.groupBy(*keys).agg(
        F.max(F.col("dist_m").isNotNull()).alias("_measured"),
        F.coalesce(F.max(F.col("dist_m") <= max_m), F.lit(False)).alias("_near"),
        F.coalesce(F.max(F.col("dist_m") > max_m), F.lit(False)).alias("_far"),
    )
    others = other_refs.select(*keys).where(F.col("PN_CON").isNotNull()).distinct().withColumn("_other", F.lit(True))
    named = poles.withColumn("PN_CON", F.col("COD_ID"))
    joined = named.join(per_pole, keys, "left").join(others, keys, "left")
    has_other = F.coalesce(F.col("_other"), F.lit(False))
    valid = has_other | (F.col("_measured") == F.lit(False)) | F.coalesce(F.col("_near"), F.lit(False))
    offending = F.coalesce(F.col("_far"), F.lit(False)) & ~has_other
    flagged = joined.withColumn("too_far", offending).withColumn("_valid", F.coalesce(valid, F.lit(False)))
    groups = list(clip) or ["_one_clip"]
    if not clip:
        flagged = flagged.withColumn("_one_clip", F.lit(1))
    worst = flagged.groupBy(*groups).agg(F.max("too_far").alias("_any"))
    flagged = flagged.join(worst, groups)
    return flagged.withColumn("keep", ~F.col("_any") | F.col("_valid")).select(
        *poles.columns, "too_far", "keep"
    )
