"""ST_ functions as Arrow-batched UDFs. Geometry travels as WKT text, with an SRID as SRID=n;WKT.

Any NULL argument gives NULL. Each batch parses each distinct text once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lathe.functions import geometry as G

@lru_cache(8192)
def _parse(text: str) -> tuple[int, G.Geometry]:
    return G.parse(text)


def _geo(text: str) -> G.Geometry:
    return _parse(text)[1]


def _text(g: G.Geometry, like: str | None = None) -> str:
    srid = _parse(like)[0] if like else 0
    return (f"SRID={srid};" if srid else "") + G.to_wkt(g)


def _typed(kind: str, wkb: bool) -> Callable[[str], str]:
    def make(text: str) -> str:
        srid, g = _parse(text)
        if kind and g[0] != kind:
            raise G.GeometryError(f"{g[0]} instead of {kind}")
        return (f"SRID={srid};" if srid else "") + G.to_wkt(g)

    return make


def _xy(i: int) -> Callable[[str], float]:
    def get(text: str) -> float:
        kind, c = _geo(text)
        if kind != "POINT" or c is None:
            raise G.GeometryError(f"a point is needed, not {kind}")
        return c[i]

    return get


def _with_srid(text: str, srid: int) -> str:
    return f"SRID={int(srid)};{G.to_wkt(_geo(text))}"


#: Fixed value: the mean radius of the earth in metres.
EARTH_RADIUS = 6_371_008.8


def _metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Great-circle distance of two points (longitude, latitude in degrees), by the haversine formula."""
    (x, y), (u, v) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(min(1.0, math.sqrt(h)))


def _within(a: str, b: str, d: float) -> bool:
    """Two points are held against a distance in metres, other pairs against one in the units of their coordinates."""
    if d < 0:
        return False
    (kind, p), (other, q) = _geo(a), _geo(b)
    if kind == other == "POINT" and p is not None and q is not None:
        return _metres(p, q) <= d
    return G.distance(_geo(a), _geo(b)) <= d


def _two(f: Callable) -> Callable[[str, str], object]:
    return lambda a, b: f(_geo(a), _geo(b))


def _one(f: Callable) -> Callable[[str], object]:
    return lambda a: f(_geo(a))


def _made(f: Callable) -> Callable:
    return lambda a, *more: _text(f(_geo(a), *more), a)


def _overlay(op: str) -> Callable[[str, str], str]:
    return lambda a, b: _text(G.overlay(_geo(a), _geo(b), op), a)


#: name -> (function of one row, result type)
FUNCTIONS: dict[str, tuple[Callable, str]] = {
    "st_geomfromtext": (_typed("", False), "string"), "st_pointfromtext": (_typed("POINT", False), "string"), "st_linefromtext": (_typed("LINESTRING", False), "string"), "st_polygonfromtext": (_typed("POLYGON", False), "string"),
    "st_geomfromwkb": (_typed("", True), "string"), "st_pointfromwkb": (_typed("POINT", True), "string"), "st_linefromwkb": (_typed("LINESTRING", True), "string"), "st_polygonfromwkb": (_typed("POLYGON", True), "string"),
    "st_x": (_xy(0), "double"), "st_y": (_xy(1), "double"),
    "st_geometrytype": (lambda a: _geo(a)[0], "string"), "st_dimension": (_one(G.dimension), "int"),
    "st_astext": (_one(G.to_wkt), "string"), "st_asbinary": (lambda a: "0x" + G.to_wkb(_geo(a)).hex().upper(), "string"), "st_asgeojson": (_one(G.to_geojson), "string"),
    "st_setsrid": (_with_srid, "string"), "st_srid": (lambda a: _parse(a)[0], "int"),
    "st_contains": (_two(G.contains), "boolean"), "st_within": (lambda a, b: G.contains(_geo(b), _geo(a)), "boolean"),
    "st_intersects": (_two(G.intersects), "boolean"), "st_disjoint": (lambda a, b: not G.intersects(_geo(a), _geo(b)), "boolean"),
    "st_equals": (_two(G.equals), "boolean"), "st_touches": (_two(G.touches), "boolean"), "st_crosses": (_two(G.crosses), "boolean"), "st_overlaps": (_two(G.overlaps), "boolean"),
    "st_covers": (_two(G.covers), "boolean"), "st_coveredby": (lambda a, b: G.covers(_geo(b), _geo(a)), "boolean"),
    "st_dwithin": (_within, "boolean"), "st_relate": (_two(G.relate), "string"),
    "st_distance": (_two(G.distance), "double"), "st_length": (_one(G.length), "double"), "st_perimeter": (_one(G.perimeter), "double"), "st_area": (_one(G.area), "double"),
    "st_centroid": (_made(G.centroid), "string"), "st_envelope": (_made(G.envelope), "string"), "st_convexhull": (_made(G.convex_hull), "string"), "st_pointonsurface": (_made(G.point_on_surface), "string"), "st_boundary": (_made(G.boundary), "string"),
    "st_hausdorffdistance": (_two(G.hausdorff), "double"), "st_simplify": (_made(G.simplify), "string"),
    "st_union": (_overlay("union"), "string"), "st_intersection": (_overlay("intersection"), "string"), "st_difference": (_overlay("difference"), "string"), "st_symdifference": (_overlay("symdifference"), "string"),
}


def udf(name: str):
    """The Arrow-batched UDF of an ST_ function."""
    f, kind = FUNCTIONS[name]

    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([None if any(v is None or v != v for v in r) else f(*r) for r in rows], dtype=object)

    n = {"st_dwithin": 3, "st_setsrid": 2, "st_simplify": 2}.get(name) or (2 if name in _BINARY else 1)
    if n == 1:
        def one(a: pd.Series) -> pd.Series:
            return run(a)
        return F.pandas_udf(one, kind)
    if n == 2:
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)
        return F.pandas_udf(two, kind)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf(three, kind)


_BINARY = frozenset("st_contains st_within st_intersects st_disjoint st_equals st_touches st_crosses st_overlaps st_covers st_coveredby st_relate st_distance st_hausdorffdistance st_union st_intersection st_difference st_symdifference".split())
#: Spellings with underscores inside.
ALIASES = {"st_geom_from_text": "st_geomfromtext", "st_point_from_text": "st_pointfromtext", "st_line_from_text": "st_linefromtext", "st_polygon_from_text": "st_polygonfromtext", "st_geom_from_wkb": "st_geomfromwkb", "st_as_text": "st_astext", "st_as_binary": "st_asbinary", "st_as_geojson": "st_asgeojson", "st_geometry_type": "st_geometrytype", "st_set_srid": "st_setsrid", "st_covered_by": "st_coveredby", "st_convex_hull": "st_convexhull", "st_point_on_surface": "st_pointonsurface", "st_hausdorff_distance": "st_hausdorffdistance", "st_sym_difference": "st_symdifference"}


def register(spark: SparkSession) -> None:
    """All ST_ functions as temporary SQL functions of the session."""
    for name in FUNCTIONS:
        spark.udf.register(name, udf(name))
    for name, own in ALIASES.items():
        spark.udf.register(name, udf(own))
