"""Scalar and geometry functions on hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.functions import scalar


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def line(*pts):
    return F.array(*[g.point(F.lit(float(x)), F.lit(float(y))) for x, y in pts])


def pt(x, y):
    return g.point(F.lit(float(x)), F.lit(float(y)))


def test_append_unique(spark):
    fb = F.array(F.lit("foo"), F.lit("bar"))
    r = one(spark, scalar.append_unique(fb, F.lit("baz")), scalar.append_unique(fb, F.lit("bar")), scalar.append_unique(F.lit(None).cast("array<string>"), F.lit("a")))
    assert r.c0 == ["foo", "bar", "baz"] and r.c1 == ["foo", "bar"] and r.c2 == ["a"]


@pytest.mark.parametrize("a,b,plain,strict", [(350.0, 10.0, 160.0, 20.0), (10.0, 350.0, 160.0, 20.0), (90.0, 270.0, 180.0, 180.0), (None, 1.0, None, None)])
def test_minimum_angle(spark, a, b, plain, strict):
    x, y = F.lit(a).cast("double"), F.lit(b).cast("double")
    r = one(spark, scalar.minimum_angle(x, y), scalar.minimum_angle(x, y, strict=True))
    assert (r.c0, r.c1) == (plain, strict)


def test_journey_id_of_a_known_journey(spark):
    r = one(spark, scalar.journey_id(F.lit("2510"), F.lit(1), F.expr("TIMESTAMP_NTZ'2020-09-23 04:02:00'"), F.lit(22), F.lit(1134)))
    assert r.c0 == "681085306edf2862f2f2b69fc053c787"


def test_interpolation_of_equal_places_is_null(spark):
    r = one(spark, scalar.linear_interpolate(F.lit(1.0), F.lit(0.0), F.lit(10.0), F.lit(2.0), F.lit(20.0)), scalar.linear_interpolate(F.lit(1.0), F.lit(2.0), F.lit(10.0), F.lit(2.0), F.lit(20.0)))
    assert r.c0 == 15.0 and r.c1 is None


def test_clock_past_midnight_and_smallint(spark):
    r = one(spark, scalar.parse_clock(F.lit("25:10:00")), scalar.to_smallint(F.lit(40000)), scalar.to_smallint(F.lit(7)), scalar.kmh(F.lit(10.0), F.lit(0.0)))
    assert (r.c0, r.c1, r.c2, r.c3) == (90600, None, 7, None)


def test_line_measures(spark):
    bent = line((0, 0), (3, 4), (3, 10))
    r = one(spark, g.length(bent), g.locate(bent, pt(4, 7)), g.distance(bent, pt(4, 7)), g.interpolate(bent, F.lit(0.5)), g.substring(bent, F.lit(0.2), F.lit(0.8)), g.nearest(bent, pt(3, 20))["beyond"])
    assert r.c0 == pytest.approx(11.0) and r.c1 == pytest.approx(8 / 11) and r.c2 == pytest.approx(1.0)
    assert (r.c3.x, r.c3.y) == pytest.approx((3.0, 4.5))
    assert [(round(p.x, 6), round(p.y, 6)) for p in r.c4] == [(1.32, 1.76), (3.0, 4.0), (3.0, 7.8)]
    assert r.c5


@pytest.mark.parametrize("share", [0.0, 0.13, 0.5, 0.77, 1.0])
def test_locate_undoes_interpolate(spark, share):
    bent = line((0, 0), (10, 0), (10, 5), (-3, 9))
    assert one(spark, g.locate(bent, g.interpolate(bent, F.lit(share)))).c0 == pytest.approx(share)


def test_sides_follow_the_line_and_flat_ends(spark):
    east = line((0, 0), (10, 0))
    r = one(spark, g.nearest(east, pt(5, 2))["side"], g.nearest(east, pt(5, -2))["side"], g.within_flat_buffer(east, pt(11, 1), 5.0), g.within_flat_buffer(east, pt(9, 1), 5.0))
    assert (r.c0, r.c1, r.c2, r.c3) == (1.0, -1.0, False, True)


def test_azimuth_and_stretch(spark):
    r = one(spark, g.azimuth(pt(0, 0), pt(1, 0)), g.azimuth(pt(1, 1), pt(1, 1)), g.translate_scale(line((0, 0), (1, 1), (2, 2)), pt(0, 0), pt(2, 2), pt(4, 6)), g.translate_scale(line((0, 0), (1, 0)), pt(0, 0), pt(1, 0), pt(3, 0)))
    assert r.c0 == pytest.approx(math.pi / 2) and r.c1 is None
    assert [(p.x, p.y) for p in r.c2] == [(0.0, 0.0), (2.0, 3.0), (4.0, 6.0)] and r.c3[1].y == 0.0


def test_projection_is_symmetric_about_its_meridian(spark):
    r = one(spark, g.project(F.lit(25.0), F.lit(60.2)), g.project(F.lit(29.0), F.lit(60.2)), g.project(F.lit(27.0), F.lit(0.0)))
    assert r.c0.x - 500000 == pytest.approx(500000 - r.c1.x, abs=1e-6) and r.c0.y == pytest.approx(r.c1.y, abs=1e-6)
    assert (r.c2.x, r.c2.y) == pytest.approx((500000.0, 0.0))


def test_wkt(spark):
    r = one(spark, g.parse_point(F.lit("POINT (388045.1 6673900)")), g.parse_linestring(F.lit("LINESTRING(1 2, 3.5 4)")))
    assert (r.c0.x, r.c0.y) == (388045.1, 6673900.0) and [(p.x, p.y) for p in r.c1] == [(1.0, 2.0), (3.5, 4.0)]


def test_a_part_of_a_line_measures_it_once(spark):
    part = g.substring(F.col("line"), F.col("a"), F.col("b"))
    assert part._jc.toString().count("aggregate(") == 1
    rows = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 6.0)], 0.2, 0.7), ([(0.0, 0.0), (4.0, 0.0), (4.0, 6.0)], 0.0, 1.0), (None, 0.1, 0.2)], "line array<struct<x:double,y:double>>, a double, b double")
    got = [r.p and [tuple(round(v, 9) for v in p) for p in r.p] for r in rows.select(part.alias("p")).collect()]
    assert got == [[(2.0, 0.0), (4.0, 0.0), (4.0, 3.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 6.0)], None]
