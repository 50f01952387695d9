"""Geometry as plain columns.

WKB bytes are decoded once, in whole Arrow batches, into doubles and an array of edges; every later test
(distance, containment, intersection, extent) is a JVM expression over those columns.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from gridlake.functions.wkb import decode, encode_boxes, encode_lines, encode_points

EDGE = StructType([StructField(n, DoubleType()) for n in ("x1", "y1", "x2", "y2")])
SHAPE = StructType(
    [
        StructField("kind", StringType()),
        StructField("is_null", BooleanType()),
        StructField("is_empty", BooleanType()),
        StructField("is_broken", BooleanType()),
        StructField("n_points", IntegerType()),
        StructField("minx", DoubleType()),
        StructField("miny", DoubleType()),
        StructField("maxx", DoubleType()),
        StructField("maxy", DoubleType()),
        StructField("parts", ArrayType(EDGE)),
        StructField("edges", ArrayType(EDGE)),
    ]
)


@F.arrow_udf(SHAPE)
def _decode(values: pa.Array) -> pa.Array:
    return decode(values)


def with_shape(df: DataFrame, geometry: str = "geometry", out: str = "shape") -> DataFrame:
    """Decode a WKB column once: kind, flags, extent, part ends and edges (op G1).

    ``out`` is a struct; write the result as a derived table when several jobs read it.
    """
    return df.withColumn(out, _decode(F.col(geometry)))


@F.arrow_udf(BinaryType())
def point_bytes(x: pa.Array, y: pa.Array) -> pa.Array:
    """WKB of points."""
    return encode_points(x, y)


@F.arrow_udf(BinaryType())
def line_bytes(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
    """WKB of straight multi-lines."""
    return encode_lines(x1, y1, x2, y2)


@F.arrow_udf(BinaryType())
def box_bytes(west: pa.Array, south: pa.Array, east: pa.Array, north: pa.Array) -> pa.Array:
    """WKB of rectangular multi-polygons."""
    return encode_boxes(west, south, east, north)


def part_ends(df: DataFrame, shape: str = "shape") -> DataFrame:
    """Two rows per line part: the first vertex (``end`` = 1) and the last (``end`` = 2)."""
    exploded = df.withColumn("_part", F.explode(F.col(f"{shape}.parts")))
    ends = F.array(
        F.struct(F.lit(1).alias("end"), F.col("_part.x1").alias("x"), F.col("_part.y1").alias("y")),
        F.struct(F.lit(2).alias("end"), F.col("_part.x2").alias("x"), F.col("_part.y2").alias("y")),
    )
    return exploded.withColumn("_end", F.explode(ends)).select(
        *[c for c in df.columns if c != shape], "_end.end", "_end.x", "_end.y"
    )


# --- expressions over edges --------------------------------------------------------------------


def box_edges(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The four sides of a rectangle as an edge array."""

    def side(a, b, c, d):
        return F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))

    return F.array(
        side(minx, miny, maxx, miny), side(maxx, miny, maxx, maxy),
        side(maxx, maxy, minx, maxy), side(minx, maxy, minx, miny),
    )


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd containment over all rings (holes included); the boundary is not treated apart."""

    def crosses(e):
        straddles = (e.y1 > y) != (e.y2 > y)
        at = (e.x2 - e.x1) * (y - e.y1) / F.nullif(e.y2 - e.y1, F.lit(0.0)) + e.x1
        return straddles & (x < at)

    hits = F.aggregate(
        edges, F.lit(0), lambda acc, e: acc + F.when(crosses(e), F.lit(1)).otherwise(F.lit(0))
    )
    return hits % 2 == 1


def distance_to_edges(x: Column, y: Column, edges: Column) -> Column:
    """Distance from a point to a polygon given by its edges; zero inside."""

    def to_edge(e):
        dx, dy = e.x2 - e.x1, e.y2 - e.y1
        length = dx * dx + dy * dy
        t = F.when(
            length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e.x1) * dx + (y - e.y1) * dy) / length))
        ).otherwise(F.lit(0.0))
        return F.hypot(x - (e.x1 + t * dx), y - (e.y1 + t * dy))

    nearest = F.array_min(F.transform(edges, to_edge))
    return F.when(inside(x, y, edges), F.lit(0.0)).otherwise(nearest)


def edges_meet(line: Column, polygon: Column) -> Column:
    """True when a line (edge array) touches or enters a polygon (edge array)."""

    def turn(ax, ay, bx, by, cx, cy):
        return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    def within(ax, ay, bx, by, cx, cy):
        return (
            (cx >= F.least(ax, bx)) & (cx <= F.greatest(ax, bx))
            & (cy >= F.least(ay, by)) & (cy <= F.greatest(ay, by))
        )

    def cross(a, b):
        o1 = turn(a.x1, a.y1, a.x2, a.y2, b.x1, b.y1)
        o2 = turn(a.x1, a.y1, a.x2, a.y2, b.x2, b.y2)
        o3 = turn(b.x1, b.y1, b.x2, b.y2, a.x1, a.y1)
        o4 = turn(b.x1, b.y1, b.x2, b.y2, a.x2, a.y2)
        return (
            ((o1 != o2) & (o3 != o4))
            | ((o1 == 0) & within(a.x1, a.y1, a.x2, a.y2, b.x1, b.y1))
            | ((o2 == 0) & within(a.x1, a.y1, a.x2, a.y2, b.x2, b.y2))
            | ((o3 == 0) & within(b.x1, b.y1, b.x2, b.y2, a.x1, a.y1))
            | ((o4 == 0) & within(b.x1, b.y1, b.x2, b.y2, a.x2, a.y2))
        )

    start = line[0]
    return inside(start.x1, start.y1, polygon) | F.exists(
        line, lambda a: F.exists(polygon, lambda b: cross(a, b))
    )


# --- projection ----------------------------------------------------------------------------------

_A, _INV_F = 6378137.0, 298.257222101
_N = (1 / _INV_F) / (2 - 1 / _INV_F)
_RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)


def _conformal(lon, lat, central_meridian: float):
    """(tangent of the conformal latitude, longitude from the meridian), both in the sphere."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s)), F.radians(lon - F.lit(central_meridian))


def _grid(xi, eta):
    east, north = eta, xi
    for j, alpha in enumerate(_ALPHA, start=1):
        east = east + F.lit(alpha) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(alpha) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    scale = 0.9996 * _RECTIFYING
    return F.lit(500_000.0) + F.lit(scale) * east, F.lit(10_000_000.0) + F.lit(scale) * north


def with_utm(
    df: DataFrame, lon: Column, lat: Column, *, x: str = "x", y: str = "y", central_meridian: float = -45.0
) -> DataFrame:
    """Adds transverse Mercator metres (GRS 80 ellipsoid, southern false northing).

    Third-order series in the third flattening, sub-millimetre inside a zone. The intermediate
    angles are columns of their own, so each is computed once per row.
    """
    t, lam = _conformal(lon, lat, central_meridian)
    staged = df.withColumns({"_t": t, "_lam": lam}).withColumns(
        {
            "_xi": F.atan2(F.col("_t"), F.cos("_lam")),
            "_eta": F.atanh(F.sin("_lam") / F.sqrt(F.lit(1.0) + F.col("_t") * F.col("_t"))),
        }
    )
    east, north = _grid(F.col("_xi"), F.col("_eta"))
    return staged.withColumns({x: east, y: north}).drop("_t", "_lam", "_xi", "_eta")
