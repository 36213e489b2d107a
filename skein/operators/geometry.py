"""Point-in-polygon for GeoJSON-like geometry structs.

Geometry columns are normalised to ``struct<type:string, coordinates:array<array<array<array<double>>>>>``:
every Polygon becomes a one-polygon MultiPolygon, and points and lines are nested to the same depth
(a Point is one ring of one position, a LineString one ring), so their coordinates are kept; ``type``
tells them apart and only polygons contain anything. The test
is an even-odd ray cast over all rings, written with higher-order functions so it runs inside
the JVM per row; a bounding-box test on the outer rings short-circuits most rows first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

RING = ArrayType(ArrayType(DoubleType()))
POLYGON = ArrayType(RING)
MULTIPOLYGON = ArrayType(POLYGON)
GEOMETRY = StructType([StructField("type", StringType()), StructField("coordinates", MULTIPOLYGON)])


def normalize_geometry(type_col: Column, coordinates_json: Column) -> Column:
    """Build the normalised geometry from a type name and the coordinates as JSON text."""
    t = F.lower(type_col)
    position = "array<double>"
    coords = (F.when(t == "polygon", F.array(F.from_json(coordinates_json, POLYGON)))
              .when(t == "multipolygon", F.from_json(coordinates_json, MULTIPOLYGON))
              .when(t == "point", F.array(F.array(F.array(F.from_json(coordinates_json, position)))))
              .when(t.isin("multipoint", "linestring"), F.array(F.array(F.from_json(coordinates_json, RING))))
              .when(t == "multilinestring", F.array(F.from_json(coordinates_json, POLYGON))))
    return F.struct(type_col.alias("type"), coords.alias("coordinates"))


def crosses(e: Column, px: Column, py: Column) -> Column:
    """Whether the ray from (px, py) towards +x crosses an edge (fields xi, yi, xj, yj)."""
    xi, yi, xj, yj = (e[c] for c in ("xi", "yi", "xj", "yj"))
    return ((yi > py) != (yj > py)) & (px < (xj - xi) * (py - yi) / (yj - yi) + xi)


def _ring_edges(ring: Column) -> Column:
    def edge(i):
        a, b = ring[i], ring[i + 1]
        return F.struct(a[0].alias("xi"), a[1].alias("yi"), b[0].alias("xj"), b[1].alias("yj"))

    return F.when(F.size(ring) >= 2, F.transform(F.sequence(F.lit(0), F.size(ring) - 2), edge)) \
        .otherwise(F.array().cast("array<struct<xi:double,yi:double,xj:double,yj:double>>"))


def edges(geom: Column) -> Column:
    """The edges of all rings, for tests of many points against one geometry."""
    return F.flatten(F.transform(F.flatten(geom["coordinates"]), _ring_edges))


def is_area(geom: Column) -> Column:
    """Whether a geometry is of a kind that can contain points."""
    return F.lower(geom["type"]).isin("polygon", "multipolygon")


def _crossings(ring: Column, px: Column, py: Column) -> Column:
    """Number of ring edges crossed by the ray from (px, py) towards +x."""
    return F.size(F.filter(_ring_edges(ring), lambda e: crosses(e, px, py)))


def contains_point(geom: Column, x: float | Column, y: float | Column) -> Column:
    """True when the geometry contains the point (holes excluded; edges undefined)."""
    px, py = (c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y))
    coords = geom["coordinates"]
    rings = F.flatten(coords)
    outer_pts = F.flatten(F.transform(coords, lambda poly: poly[0]))
    xs = F.transform(outer_pts, lambda p: p[0])
    ys = F.transform(outer_pts, lambda p: p[1])
    in_box = (F.array_min(xs) <= px) & (px <= F.array_max(xs)) & (F.array_min(ys) <= py) & (py <= F.array_max(ys))
    n = F.aggregate(rings, F.lit(0), lambda acc, r: acc + _crossings(r, px, py))
    return F.when(is_area(geom) & in_box, (n % 2) == 1).otherwise(F.lit(False))
