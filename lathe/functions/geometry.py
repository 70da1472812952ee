"""Planar geometry on WKT and WKB: parsing, measures, predicates and polygon overlay.

A geometry is (type, coordinates): a point is a pair or None, a line a list of pairs, a polygon a list of closed
rings, a multi geometry or collection a list of those. Predicates cut segments where they meet the other
geometry and test the middle of each piece, which decides inside, outside or boundary exactly.
"""

from __future__ import annotations

import json
import math
import re
import struct

TYPES = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")
EPS = 1e-12
Geometry = tuple


class GeometryError(ValueError):
    """Text or bytes that are no geometry, or an operation on a geometry that has none."""


# Text and bytes -------------------------------------------------------------------------------------
_SCAN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def parse(text: str) -> tuple[int, Geometry]:
    """(SRID, geometry) of WKT, EWKT or hex WKB."""
    srid = 0
    text = text.strip()
    if m := re.match(r"(?i)SRID=(\d+);", text):
        srid, text = int(m[1]), text[m.end() :]
    if re.match(r"0[xX]", text) or re.fullmatch(r"[0-9a-fA-F]{10,}", text):
        return srid, from_wkb(bytes.fromhex(re.sub(r"^0[xX]", "", text)))
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _SCAN.match(text, at)
        if not m:
            raise GeometryError(f"not WKT: {text[:60]}")
        tokens.append(m[1])
        at = m.end()
    g, end = _wkt(tokens, 0)
    if end != len(tokens):
        raise GeometryError(f"text after the geometry: {text[:60]}")
    return srid, g


def _wkt(tokens: list[str], i: int) -> tuple[Geometry, int]:
    kind = tokens[i].upper() if i < len(tokens) else ""
    if kind not in TYPES:
        raise GeometryError(f"unknown geometry {kind}")
    i += 1
    if i < len(tokens) and tokens[i].upper() == "EMPTY":
        return (kind, None if kind == "POINT" else []), i + 1
    if i >= len(tokens) or tokens[i] != "(":
        raise GeometryError(f"{kind} without coordinates")
    if kind == "GEOMETRYCOLLECTION":
        out, i = [], i + 1
        while True:
            g, i = _wkt(tokens, i)
            out.append(g)
            if tokens[i] == ")":
                return (kind, out), i + 1
            i += 1
    depth = {"POINT": 0, "LINESTRING": 1, "MULTIPOINT": 1, "POLYGON": 2, "MULTILINESTRING": 2, "MULTIPOLYGON": 3}[kind]
    try:
        value, i = _nested(tokens, i, max(depth, 1))
    except (IndexError, ValueError) as e:
        raise GeometryError(f"broken {kind}") from e
    value = value[0] if depth == 0 else value
    return (kind, _closed(kind, value)), i


def _nested(tokens: list[str], i: int, depth: int) -> tuple[list, int]:
    out, i = [], i + 1  # after "("
    while True:
        if depth > 1:
            value, i = _nested(tokens, i, depth - 1)
        elif tokens[i] == "(":  # MULTIPOINT((1 2), ...)
            value, i = (float(tokens[i + 1]), float(tokens[i + 2])), i + 4
        else:
            value, i = (float(tokens[i]), float(tokens[i + 1])), i + 2
            while tokens[i] not in ",)":  # further ordinates are left out
                i += 1
        out.append(value)
        if tokens[i] == ")":
            return out, i + 1
        i += 1


def _closed(kind: str, value):
    polygons = [value] if kind == "POLYGON" else value if kind == "MULTIPOLYGON" else []
    for rings in polygons:
        for r in rings:
            if len(r) < 4 or r[0] != r[-1]:
                raise GeometryError("a ring has to be closed and to have four points at least")
    if kind == "LINESTRING" and len(value) < 2:
        raise GeometryError("a line needs two points")
    return value


def _num(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def to_wkt(g: Geometry) -> str:
    kind, c = g
    if not c:
        return f"{kind} EMPTY"
    pt = lambda p: f"{_num(p[0])} {_num(p[1])}"
    line = lambda ps: f"({', '.join(map(pt, ps))})"
    poly = lambda rs: f"({', '.join(map(line, rs))})"
    body = {"POINT": lambda: f"({pt(c)})", "LINESTRING": lambda: line(c), "POLYGON": lambda: poly(c), "MULTIPOINT": lambda: f"({', '.join(f'({pt(p)})' for p in c)})", "MULTILINESTRING": lambda: poly(c), "MULTIPOLYGON": lambda: f"({', '.join(map(poly, c))})", "GEOMETRYCOLLECTION": lambda: f"({', '.join(map(to_wkt, c))})"}[kind]()
    return kind + body


def from_wkb(data: bytes) -> Geometry:
    try:
        g, end = _wkb(data, 0)
    except (struct.error, IndexError) as e:
        raise GeometryError("broken WKB") from e
    if end != len(data):
        raise GeometryError("bytes after the geometry")
    return g


def _wkb(data: bytes, at: int) -> tuple[Geometry, int]:
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    code &= 0xFF
    if not 1 <= code <= 7:
        raise GeometryError(f"WKB type {code}")

    def points(at: int) -> tuple[list, int]:
        (n,) = struct.unpack_from(f"{order}I", data, at)
        return [struct.unpack_from(f"{order}2d", data, at + 4 + 16 * i) for i in range(n)], at + 4 + 16 * n

    kind = TYPES[code - 1]
    if code == 1:
        p = struct.unpack_from(f"{order}2d", data, at)
        return (kind, None if math.isnan(p[0]) else p), at + 16
    if code == 2:
        ps, at = points(at)
        return (kind, ps), at
    (n,) = struct.unpack_from(f"{order}I", data, at)
    at, out = at + 4, []
    for _ in range(n):
        x, at = points(at) if code == 3 else _wkb(data, at)
        out.append(x if code in (3, 7) else x[1])
    return (kind, out), at


def to_wkb(g: Geometry) -> bytes:
    kind, c = g
    head = struct.pack("<BI", 1, TYPES.index(kind) + 1)
    line = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<2d", *p) for p in ps)
    if kind == "POINT":
        return head + struct.pack("<2d", *(c or (math.nan, math.nan)))
    if kind == "LINESTRING":
        return head + line(c)
    parts = [line(r) for r in c] if kind == "POLYGON" else [to_wkb(x) for x in (c if kind == "GEOMETRYCOLLECTION" else [(kind[5:], x) for x in c])]
    return head + struct.pack("<I", len(c)) + b"".join(parts)


def to_geojson(g: Geometry) -> str:
    names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon", "GEOMETRYCOLLECTION": "GeometryCollection"}

    def plain(x):
        return [plain(y) for y in x] if isinstance(x, (list, tuple)) else int(x) if x == int(x) else x

    def make(g):
        if g[0] == "GEOMETRYCOLLECTION":
            return {"type": names[g[0]], "geometries": [make(x) for x in g[1]]}
        return {"type": names[g[0]], "coordinates": plain(g[1] or [])}

    return json.dumps(make(g), separators=(",", ":"))


# Parts ------------------------------------------------------------------------------------------------
def parts(g: Geometry) -> list[Geometry]:
    """Simple geometries of a multi geometry or collection."""
    kind, c = g
    if not c:
        return []
    if kind == "GEOMETRYCOLLECTION":
        return [x for p in c for x in parts(p)]
    return [(kind[5:], x) for x in c] if kind.startswith("MULTI") else [g]


def points_of(g: Geometry) -> list[tuple]:
    return [p for kind, c in parts(g) for p in ([c] if kind == "POINT" else c if kind == "LINESTRING" else [q for r in c for q in r])]


def segments(g: Geometry) -> list[tuple]:
    return [s for kind, c in parts(g) if kind != "POINT" for line in ([c] if kind == "LINESTRING" else c) for s in zip(line, line[1:], strict=False)]


def dimension(g: Geometry) -> int:
    return max((0 if k == "POINT" else 1 if k == "LINESTRING" else 2 for k, _ in parts(g)), default=0 if "POINT" in g[0] else 1 if "LINE" in g[0] else 2 if "POLYGON" in g[0] else 0)


def bounds(g: Geometry) -> tuple[float, float, float, float] | None:
    ps = points_of(g)
    return (min(p[0] for p in ps), min(p[1] for p in ps), max(p[0] for p in ps), max(p[1] for p in ps)) if ps else None


# Predicates -------------------------------------------------------------------------------------------
def _side(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _near(x: float, a, b) -> bool:
    return abs(x) <= EPS * max(1.0, abs(a[0]), abs(a[1]), abs(b[0]), abs(b[1])) ** 2


def on_segment(p, a, b) -> bool:
    return _near(_side(a, b, p), a, b) and min(a[0], b[0]) - EPS <= p[0] <= max(a[0], b[0]) + EPS and min(a[1], b[1]) - EPS <= p[1] <= max(a[1], b[1]) + EPS


def where(p, g: Geometry) -> int:
    """1 in the interior, 0 on the boundary, -1 outside."""
    best = -1
    ends: dict[tuple, int] = {}
    for kind, c in parts(g):
        if kind == "POINT":
            best = max(best, 1 if math.dist(p, c) <= EPS else -1)
        elif kind == "LINESTRING":
            if any(on_segment(p, a, b) for a, b in zip(c, c[1:], strict=False)):
                tip = c[0] != c[-1] and (math.dist(p, c[0]) <= EPS or math.dist(p, c[-1]) <= EPS)
                ends[tuple(p)] = ends.get(tuple(p), 0) + tip
                best = max(best, 0 if tip else 1)
        else:
            best = max(best, _in_polygon(p, c))
    return 1 if best == 0 and ends and sum(ends.values()) % 2 == 0 and sum(ends.values()) else best


def _in_polygon(p, rings) -> int:
    inside = False
    for r in rings:
        for a, b in zip(r, r[1:], strict=False):
            if on_segment(p, a, b):
                return 0
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
    return 1 if inside else -1


def crossing(a, b, c, d) -> list[float]:
    """Places on a-b, from 0 to 1, where c-d meets it; ends of a shared stretch."""
    s1, s2 = _side(c, d, a), _side(c, d, b)
    if _near(s1, c, d) and _near(s2, c, d):
        length = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        if not length:
            return [0.0] if on_segment(a, c, d) else []
        ts = [((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / length for p in (c, d)]
        return [t for t in ts if -EPS <= t <= 1 + EPS] + [t for t, p in ((0.0, a), (1.0, b)) if on_segment(p, c, d)]
    if s1 == s2:
        return []
    t = s1 / (s1 - s2)
    if not -EPS <= t <= 1 + EPS:
        return []
    p = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    return [min(1.0, max(0.0, t))] if min(c[0], d[0]) - 1e-9 <= p[0] <= max(c[0], d[0]) + 1e-9 and min(c[1], d[1]) - 1e-9 <= p[1] <= max(c[1], d[1]) + 1e-9 else []


def pieces(g: Geometry, other: Geometry) -> list[tuple]:
    """Segments of g cut wherever a segment or point of other meets them."""
    cutters, single = segments(other), [c for k, c in parts(other) if k == "POINT"]
    out = []
    for a, b in segments(g):
        ts = {0.0, 1.0}
        for c, d in cutters:
            if max(c[0], d[0]) >= min(a[0], b[0]) - EPS and min(c[0], d[0]) <= max(a[0], b[0]) + EPS and max(c[1], d[1]) >= min(a[1], b[1]) - EPS and min(c[1], d[1]) <= max(a[1], b[1]) + EPS:
                ts.update(crossing(a, b, c, d))
        for p in single:
            ts.update(crossing(a, b, p, p) if on_segment(p, a, b) else [])
        cuts = sorted(ts)
        at = lambda t, a=a, b=b: a if t <= 0 else b if t >= 1 else (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
        out += [(at(s), at(t)) for s, t in zip(cuts, cuts[1:], strict=False) if t - s > EPS]
    return out


def _mid(s) -> tuple:
    return ((s[0][0] + s[1][0]) / 2, (s[0][1] + s[1][1]) / 2)


def _samples(g: Geometry, other: Geometry) -> list[tuple]:
    """Points that stand for all of g as seen from other: vertices, middles of pieces, a point inside of each area."""
    return points_of(g) + [_mid(s) for s in pieces(g, other)] + [s for s, t in pieces(g, other)] + [inner_point(c) for k, c in parts(g) if k == "POLYGON"]


def intersects(a: Geometry, b: Geometry) -> bool:
    return any(where(p, b) >= 0 for p in _samples(a, b)) or any(where(p, a) >= 0 for p in _samples(b, a))


def covers(a: Geometry, b: Geometry) -> bool:
    """No point of b is outside a. An area is also not covered if a's boundary or a hole lies inside it."""
    if not points_of(b) or dimension(b) > dimension(a) or any(where(p, a) < 0 for p in _samples(b, a)):
        return False
    return not (dimension(b) == 2 and any(where(_mid(s), b) == 1 for s in pieces(a, b) if _exposed(s, a)))


def _exposed(s, a: Geometry) -> bool:
    """Whether a piece of a's boundary has outside on one side."""
    (x0, y0), (x1, y1) = s
    m, n = _mid(s), math.hypot(x1 - x0, y1 - y0)
    h = max(n * 1e-6, 1e-9)
    return any(where((m[0] + k * (y0 - y1) / n * h, m[1] + k * (x1 - x0) / n * h), a) < 0 for k in (1, -1))


def interiors_meet(a: Geometry, b: Geometry) -> bool:
    if dimension(a) == dimension(b) == 2 and (any(where(_mid(s), b) == 1 for s in pieces(a, b)) or any(where(_mid(s), a) == 1 for s in pieces(b, a))):
        return True  # next to a boundary inside the other area there are points of both
    both = lambda p: where(p, a) == 1 and where(p, b) == 1
    return any(map(both, _samples(a, b))) or any(map(both, _samples(b, a)))


def contains(a: Geometry, b: Geometry) -> bool:
    return covers(a, b) and interiors_meet(a, b)


def equals(a: Geometry, b: Geometry) -> bool:
    return dimension(a) == dimension(b) and covers(a, b) and covers(b, a)


def touches(a: Geometry, b: Geometry) -> bool:
    return intersects(a, b) and not interiors_meet(a, b)


def crosses(a: Geometry, b: Geometry) -> bool:
    da, db = dimension(a), dimension(b)
    if da > db:
        return crosses(b, a)
    if da == db == 1:
        return interiors_meet(a, b) and not any(where(_mid(s), b) >= 0 for s in pieces(a, b))
    return da < db and interiors_meet(a, b) and not covers(b, a)


def overlaps(a: Geometry, b: Geometry) -> bool:
    if dimension(a) != dimension(b) or covers(a, b) or covers(b, a):
        return False
    if dimension(a) == 1:
        return any(where(_mid(s), b) >= 0 for s in pieces(a, b))
    return interiors_meet(a, b)


def relate(a: Geometry, b: Geometry) -> str:
    """One of five intersection matrices: equal, contains, within, meets, apart."""
    if equals(a, b):
        return "T*F**FFF*"
    if contains(a, b):
        return "T*****FF*"
    if contains(b, a):
        return "T*F**F***"
    return "T********" if intersects(a, b) else "FF*FF****"


# Measures ---------------------------------------------------------------------------------------------
def _to_segment(p, a, b) -> float:
    n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = 0.0 if not n else max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / n))
    return math.hypot(p[0] - a[0] - t * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))


def distance(a: Geometry, b: Geometry) -> float:
    """Least Euclidean distance, 0 if they meet."""
    if intersects(a, b):
        return 0.0
    pa, pb, sa, sb = points_of(a), points_of(b), segments(a), segments(b)
    ds = [math.dist(p, q) for p in pa for q in pb] + [_to_segment(p, *s) for p in pa for s in sb] + [_to_segment(p, *s) for p in pb for s in sa]
    if not ds:
        raise GeometryError("an empty geometry has no distance")
    return min(ds)


def length(g: Geometry) -> float:
    return sum(math.dist(p, q) for k, c in parts(g) if k == "LINESTRING" for p, q in zip(c, c[1:], strict=False))


def perimeter(g: Geometry) -> float:
    return sum(math.dist(p, q) for k, c in parts(g) if k == "POLYGON" for r in c for p, q in zip(r, r[1:], strict=False))


def _ring_area(r) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2


def area(g: Geometry) -> float:
    return sum(abs(_ring_area(c[0])) - sum(abs(_ring_area(h)) for h in c[1:]) for k, c in parts(g) if k == "POLYGON")


def centroid(g: Geometry) -> Geometry:
    total = x = y = 0.0
    d = dimension(g)
    ox, oy = (points_of(g) or [(0.0, 0.0)])[0]  # areas relative to a vertex lose fewer digits
    for k, c in parts(g):
        if d == 2 and k == "POLYGON":
            for i, r in enumerate(c):
                sign = (1 if i == 0 else -1) * (1 if _ring_area(r) >= 0 else -1)
                for a, b in zip(r, r[1:], strict=False):
                    (ax, ay), (bx, by) = (a[0] - ox, a[1] - oy), (b[0] - ox, b[1] - oy)
                    w = sign * (ax * by - bx * ay) / 2
                    total, x, y = total + w, x + w * (ax + bx) / 3, y + w * (ay + by) / 3
        elif d == 1 and k == "LINESTRING":
            for a, b in zip(c, c[1:], strict=False):
                w = math.dist(a, b)
                total, x, y = total + w, x + w * (a[0] + b[0]) / 2, y + w * (a[1] + b[1]) / 2
        elif d == 0:
            total, x, y = total + 1, x + c[0] - ox, y + c[1] - oy
    return ("POINT", (ox + x / total, oy + y / total) if total else None)


def envelope(g: Geometry) -> Geometry:
    if not (b := bounds(g)):
        return ("POLYGON", [])
    return ("POLYGON", [[(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]), (b[0], b[1])]])


def convex_hull(g: Geometry) -> Geometry:
    ps = sorted(set(points_of(g)))
    if len(ps) < 3:
        return ("POINT", ps[0]) if len(ps) == 1 else ("LINESTRING", ps)

    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and _side(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(ps) + half(ps[::-1])
    return ("LINESTRING", [ring[0], ring[-1]]) if len(ring) < 3 else ("POLYGON", [[*ring, ring[0]]])


def inner_point(rings) -> tuple:
    """A point inside of a polygon: the middle of the longest stretch inside on a line between vertices."""
    ys = sorted({p[1] for p in rings[0]})
    best = (-1.0, rings[0][0])
    for lo, hi in zip(ys, ys[1:], strict=False):
        y = (lo + hi) / 2
        xs = sorted((b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in rings for a, b in zip(r, r[1:], strict=False) if (a[1] > y) != (b[1] > y))
        for x0, x1 in zip(xs[::2], xs[1::2], strict=False):
            best = max(best, (x1 - x0, ((x0 + x1) / 2, y)))
    return best[1]


def point_on_surface(g: Geometry) -> Geometry:
    areas = [c for k, c in parts(g) if k == "POLYGON"]
    if areas:
        return ("POINT", inner_point(max(areas, key=lambda c: area(("POLYGON", c)))))
    lines = [c for k, c in parts(g) if k == "LINESTRING"]
    if lines:
        line = max(lines, key=lambda c: length(("LINESTRING", c)))
        return ("POINT", line[len(line) // 2] if len(line) > 2 else _mid(line))
    ps = points_of(g)
    return ("POINT", ps[0] if ps else None)


def boundary(g: Geometry) -> Geometry:
    d = dimension(g)
    if d == 2:
        rings = [r for k, c in parts(g) if k == "POLYGON" for r in c]
        return ("LINESTRING", rings[0]) if len(rings) == 1 else ("MULTILINESTRING", rings)
    if d == 1:
        ends: dict[tuple, int] = {}
        for k, c in parts(g):
            if k == "LINESTRING":
                for p in (c[0], c[-1]):
                    ends[p] = ends.get(p, 0) + 1
        return ("MULTIPOINT", sorted(p for p, n in ends.items() if n % 2))
    return ("GEOMETRYCOLLECTION", [])


def hausdorff(a: Geometry, b: Geometry) -> float:
    """Over vertices."""
    pa, pb = points_of(a), points_of(b)
    one = lambda x, y: max(min(math.dist(p, q) for q in y) for p in x)
    return max(one(pa, pb), one(pb, pa))


def _thin(line, tolerance: float):
    keep, stack = {0, len(line) - 1}, [(0, len(line) - 1)]
    while stack:
        i, j = stack.pop()
        far = max(range(i + 1, j), key=lambda k: _to_segment(line[k], line[i], line[j]), default=None)
        if far is not None and _to_segment(line[far], line[i], line[j]) > tolerance:
            keep.add(far)
            stack += [(i, far), (far, j)]
    return [line[k] for k in sorted(keep)]


def simplify(g: Geometry, tolerance: float) -> Geometry:
    """Douglas-Peucker; a ring keeps its shape if fewer than four points would be left."""
    ring = lambda r: t if len(t := _thin(r, tolerance)) >= 4 else r
    kind, c = g
    if kind == "LINESTRING":
        return (kind, _thin(c, tolerance))
    if kind == "MULTILINESTRING":
        return (kind, [_thin(x, tolerance) for x in c])
    if kind == "POLYGON":
        return (kind, [ring(r) for r in c])
    if kind == "MULTIPOLYGON":
        return (kind, [[ring(r) for r in p] for p in c])
    if kind == "GEOMETRYCOLLECTION":
        return (kind, [simplify(x, tolerance) for x in c])
    return g


def overlay(a: Geometry, b: Geometry, op: str) -> Geometry:
    """union, intersection, difference or symdifference of polygons: choose boundary pieces, then join them to rings."""
    if dimension(a) != 2 or dimension(b) != 2:
        raise GeometryError(f"{op} needs polygons")
    if op == "symdifference":
        polygons = [c for x, y in ((a, b), (b, a)) for _, c in parts(overlay(x, y, "difference"))]
        return ("MULTIPOLYGON", polygons) if len(polygons) != 1 else ("POLYGON", polygons[0])
    snap = lambda p: (round(p[0], 9) + 0.0, round(p[1], 9) + 0.0)
    edges: set[tuple] = set()
    shared = {}
    for first, x, y in ((True, _wound(a), b), (False, _wound(b), a)):
        for s, t in pieces(x, y):
            at = where(_mid((s, t)), y)
            s, t = snap(s), snap(t)
            if s == t:
                continue
            if at == 0:
                shared.setdefault(frozenset((s, t)), []).append((first, s, t))
            elif op == "union" and at < 0 or op == "intersection" and at > 0 or op == "difference" and first and at < 0:
                edges.add((s, t))
            elif op == "difference" and not first and at > 0:
                edges.add((t, s))
    for both in shared.values():
        same = len({(s, t) for _, s, t in both}) == 1
        s, t = next(((s, t) for first, s, t in both if first), both[0][1:])
        if same == (op != "difference"):
            edges.add((s, t))
    return _rings(edges)


def _wound(g: Geometry) -> Geometry:
    """Shells counter-clockwise, holes clockwise."""
    turn = lambda r, ccw: r if (_ring_area(r) > 0) == ccw else r[::-1]
    return ("MULTIPOLYGON", [[turn(r, i == 0) for i, r in enumerate(c)] for k, c in parts(g) if k == "POLYGON"])


def _rings(edges: set[tuple]) -> Geometry:
    leave: dict[tuple, list] = {}
    for s, t in sorted(edges):
        leave.setdefault(s, []).append(t)
    shells, holes = [], []
    while leave:
        start = next(iter(leave))
        ring = [start]
        while True:
            s = ring[-1]
            onward = leave.get(s)
            if not onward:
                break
            if len(ring) > 1 and len(onward) > 1:  # the sharpest turn to the right keeps rings apart
                back = math.atan2(ring[-2][1] - s[1], ring[-2][0] - s[0])
                t = min(onward, key=lambda q: (back - math.atan2(q[1] - s[1], q[0] - s[0])) % (2 * math.pi) or 2 * math.pi)
            else:
                t = onward[0]
            onward.remove(t)
            if not onward:
                del leave[s]
            if t in ring:
                k = ring.index(t)
                loop = _straight([*ring[k:], t])
                if len(loop) >= 4:
                    (shells if _ring_area(loop) > 0 else holes).append(loop)
                del ring[k + 1 :]
                if len(ring) == 1 and ring[0] not in leave:
                    break
            else:
                ring.append(t)
    polygons = [[s] for s in shells]
    for h in holes:
        home = [p for p in polygons if _in_polygon(inner_point([h]), [p[0]]) > 0]
        if home:
            min(home, key=lambda p: _ring_area(p[0])).append(h)
    return ("POLYGON", polygons[0]) if len(polygons) == 1 else ("MULTIPOLYGON", polygons) if polygons else ("POLYGON", [])


def _straight(ring) -> list:
    """Without points in the middle of straight lines."""
    body = ring[:-1]
    out = [p for i, p in enumerate(body) if abs(_side(body[i - 1], body[(i + 1) % len(body)], p)) > 1e-9]
    return [*out, out[0]] if len(out) >= 3 else []
