"""Extents in ground metres against circles walked point by point, across the date line and at the poles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridsurvey.operators import spatial


def extent(spark, points, metres):
    df = spark.createDataFrame(points, "longitude double, latitude double")
    return spatial.ground_extent(df, "longitude", "latitude", metres).first()


def circle(lon, lat, metres, steps=720):
    """Points at a ground distance from a centre, by the direct problem on the sphere."""
    d, lat, lon = metres / spatial.EARTH_RADIUS, math.radians(lat), math.radians(lon)
    for i in range(steps):
        b = 2 * math.pi * i / steps
        y = math.asin(math.sin(lat) * math.cos(d) + math.cos(lat) * math.sin(d) * math.cos(b))
        x = lon + math.atan2(math.sin(b) * math.sin(d) * math.cos(lat), math.cos(d) - math.sin(lat) * math.sin(y))
        yield math.degrees(x), math.degrees(y)


def holds(box, lon, lat, slack=1e-9):
    width = (box.xmax - box.xmin) % 360 if box.xmax - box.xmin != 360 else 360
    return (lon - box.xmin + slack) % 360 <= width + 2 * slack and box.ymin - slack <= lat <= box.ymax + slack


@pytest.mark.parametrize("centre", [(-77.0, 40.0), (179.9, -17.0), (-180.0, 0.0), (20.0, 78.0)])
def test_holds_all_circles_and_no_more(spark, centre):
    rng = random.Random(1)
    points = [(centre[0] + rng.uniform(-2, 2), centre[1] + rng.uniform(-2, 2)) for _ in range(40)]
    points = [((x + 180) % 360 - 180, y) for x, y in points]
    box = extent(spark, points, 30_000)
    walked = [p for point in points for p in circle(*point, 30_000)]
    assert all(holds(box, *p) for p in walked)
    # each side is reached by a circle
    offset = [(x - box.xmin) % 360 for x, _ in walked]
    assert min(min(o, 360 - o) for o in offset) < 1e-3 and (box.xmax - box.xmin) % 360 - max(o for o in offset if o < 180) < 1e-3
    assert box.ymin == pytest.approx(min(y for _, y in walked), abs=1e-3) and box.ymax == pytest.approx(max(y for _, y in walked), abs=1e-3)


def test_date_line_and_poles(spark):
    box = extent(spark, [(179.0, 0.0), (-179.0, 10.0)], 0)
    assert (box.xmin, box.xmax) == (pytest.approx(179), pytest.approx(-179)) and (box.ymin, box.ymax) == (0, 10)
    near_pole = extent(spark, [(30.0, 89.9), (31.0, 60.0)], 20_000)
    assert (near_pole.xmin, near_pole.xmax, near_pole.ymax) == (-180, 180, 90) and near_pole.ymin < 60
    assert tuple(extent(spark, [(30.0, 60.0)], 0)) == pytest.approx((30, 60, 30, 60))
    # one circle over the date line covers the gap that starts the circle of longitudes
    wide = extent(spark, [(179.5, 0.0), (-179.0, 0.0), (-60.0, 0.0)], 300_000)
    assert wide.xmin == pytest.approx(179.5 - 300_000 / spatial.EARTH_RADIUS * 180 / math.pi, abs=0.01) and -58 < wide.xmax < -57


def test_all_around_has_no_ends(spark):
    around = [(x / 4 - 180, 1.0) for x in range(1440)]
    assert extent(spark, around, 20_000).xmin == -180 and extent(spark, around, 20_000).xmax == 180
    # one missing point leaves a gap, whose sides are the ends
    gap = extent(spark, [p for p in around if p[0] != 12.0], 1_000)
    assert gap.xmin < gap.xmax + 360 and extent(spark, around, 0).xmax != 180


def test_ground_metres_do_not_shrink_with_latitude(spark):
    for lat in (0.0, 40.0, 70.0):
        box = extent(spark, [(5.0, lat)], 1_000)
        metres = math.radians(box.xmax - box.xmin) / 2 * math.cos(math.radians(lat)) * spatial.EARTH_RADIUS
        assert metres == pytest.approx(1_000, rel=1e-5)


def test_missing_places_and_groups(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", None, 5.0), ("a", float("nan"), 5.0), ("a", 3.0, 95.0), (None, 7.0, 8.0), ("b", None, None)],
        "g string, longitude double, latitude double")
    got = {r.g: tuple(r)[1:] for r in spatial.ground_extent(df, "longitude", "latitude", 0, ["g"]).collect()}
    assert got == {"a": pytest.approx((1, 2, 1, 2)), None: pytest.approx((7, 8, 7, 8))}
    assert tuple(spatial.ground_extent(df.filter(F.lit(False)), "longitude", "latitude").first()) == (None, None, None, None)
