import pytest

from lathe.functions import geometry as G

P = lambda t: G.parse(t)[1]
SQUARE = P("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))")
HOLED = P("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))")


@pytest.mark.parametrize("text", ["POINT(1 2)", "LINESTRING(0 0, 1 1.5)", "POLYGON((0 0, 1 0, 1 1, 0 0))", "MULTIPOINT((1 2), (3 4))", "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION(POINT(1 2), LINESTRING(0 0, 1 1))", "POINT EMPTY"])
def test_round_trips(text):
    g = P(text)
    assert G.to_wkt(g).replace(" ", "") == text.replace(" ", "")
    assert G.from_wkb(G.to_wkb(g)) == g


def test_errors():
    for bad in ("POINT(1)", "POLYGON((0 0, 1 0, 1 1))", "CIRCLE(1)", "LINESTRING(1 1)"):
        with pytest.raises(G.GeometryError):
            G.parse(bad)


def test_predicates():
    assert G.contains(SQUARE, P("POINT(1 1)")) and not G.contains(SQUARE, P("POINT(0 1)")) and G.covers(SQUARE, P("POINT(0 1)"))
    assert not G.contains(HOLED, P("POINT(2 2)")) and G.intersects(HOLED, P("POINT(1 1)"))
    assert G.touches(SQUARE, P("POLYGON((4 0, 6 0, 6 4, 4 4, 4 0))"))
    assert G.overlaps(SQUARE, P("POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))"))
    assert G.crosses(P("LINESTRING(-1 1, 5 1)"), SQUARE) and G.crosses(P("LINESTRING(0 0, 2 2)"), P("LINESTRING(0 2, 2 0)"))
    assert G.equals(SQUARE, P("POLYGON((4 4, 0 4, 0 0, 4 0, 4 4))"))
    assert not G.covers(HOLED, SQUARE) and G.covers(SQUARE, HOLED)
    assert not G.intersects(SQUARE, P("POINT(9 9)"))


def test_measures():
    assert G.area(HOLED) == 12 and G.perimeter(HOLED) == 24
    assert G.distance(P("POINT(7 8)"), SQUARE) == 5
    assert G.centroid(SQUARE) == ("POINT", (2, 2))
    assert G.area(G.convex_hull(P("MULTIPOINT((0 0), (4 0), (2 1), (4 4), (0 4))"))) == 16
    assert G.simplify(P("LINESTRING(0 0, 1 0.01, 2 0)"), 0.1) == ("LINESTRING", [(0, 0), (2, 0)])
    assert G.hausdorff(P("LINESTRING(0 0, 2 0)"), P("LINESTRING(0 1, 2 1)")) == 1
    assert G.where(G.inner_point(HOLED[1]), HOLED) == 1


@pytest.mark.parametrize(("other", "shared"), [("POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))", 4), ("POLYGON((4 0, 6 0, 6 4, 4 4, 4 0))", 0), ("POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", 1), ("POLYGON((0 0, 2 0, 2 4, 0 4, 0 0))", 8), ("POLYGON((9 9, 10 9, 10 10, 9 9))", 0)])
def test_overlay(other, shared):
    b = P(other)
    assert G.area(G.overlay(SQUARE, b, "intersection")) == pytest.approx(shared)
    assert G.area(G.overlay(SQUARE, b, "union")) == pytest.approx(16 + G.area(b) - shared)
    assert G.area(G.overlay(SQUARE, b, "difference")) == pytest.approx(16 - shared)
    assert G.area(G.overlay(SQUARE, b, "symdifference")) == pytest.approx(16 + G.area(b) - 2 * shared)


def test_sql(spark):
    from lathe.functions import spatial

    spatial.register(spark)
    r = spark.sql("SELECT st_srid(st_setsrid('POINT(1 2)', 4326)), st_asgeojson('POINT(1 2)'), st_x(NULL), st_astext(st_geom_from_text('point (3 4)'))").first()
    assert tuple(r) == (4326, '{"type":"Point","coordinates":[1,2]}', None, "POINT(3 4)")
