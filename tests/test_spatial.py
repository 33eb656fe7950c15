import math
import random

from pyspark.sql import functions as F

from gridsurvey.operators import spatial

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
NOTCH = [(2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (3.0, 1.0), (2.0, 2.0)]  # open ring, not convex


def polygons(spark):
    data = [(1, SQUARE), (2, NOTCH), (3, [(9.0, 9.0), (9.5, 9.0), (9.0, 9.5), (9.0, 9.0)])]
    return spark.createDataFrame(data, "pba2_block int, ring array<struct<x: double, y: double>>")


def test_cover_includes_edges_and_vertices(spark):
    points = {
        "inside": (0.5, 0.5), "edge": (1.0, 0.5), "vertex": (0.0, 0.0), "outside": (1.0001, 0.5),
        "notch in": (2.5, 1.2), "notch out": (3.0, 1.5), "notch tip": (3.0, 1.0), "closing edge": (2.0, 1.0),
        "slope": (3.5, 1.5),
    }
    df = spark.createDataFrame([(n, x, y) for n, (x, y) in points.items()], "name string, longitude double, latitude double")
    for cell in (0.3, 1.0, 50.0):
        got = spatial.join_covering(polygons(spark), df, "pba2_block", cell)
        assert {(r.pba2_block, r.name) for r in got.collect()} == {
            (1, "inside"), (1, "edge"), (1, "vertex"), (2, "notch in"), (2, "notch tip"), (2, "closing edge"),
            (2, "slope"), (3, None),
        }
        assert got.count() == 8


def test_crowded_cell_keeps_every_pair(spark):
    points = spark.range(3000).select("id", F.lit(0.25).alias("longitude"), (F.col("id") / 3000).alias("latitude"))
    got = spatial.join_covering(polygons(spark), points, "pba2_block", 10.0, salts=5).filter("pba2_block = 1")
    assert got.select("id").distinct().count() == got.count() == 3000


def test_holes_and_parts(spark):
    hole = [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25)]
    part = [(5.0, 0.0), (6.0, 0.0), (6.0, 1.0), (5.0, 0.0)]
    df = spark.createDataFrame([(1, [SQUARE, hole, part])], "pba2_block int, rings array<array<struct<x: double, y: double>>>")
    points = {"in": (0.1, 0.1), "hole": (0.5, 0.5), "rim": (0.25, 0.5), "part": (5.9, 0.5), "between": (3.0, 0.5)}
    places = spark.createDataFrame([(n, x, y) for n, (x, y) in points.items()], "name string, longitude double, latitude double")
    got = spatial.join_covering(df, places, "pba2_block", 0.5)
    assert {r.name for r in got.collect()} == {"in", "rim", "part"}


def in_hull(points, p):
    """p is outside if all points lie strictly to one side of some line through p."""
    angles = sorted(math.atan2(y - p[1], x - p[0]) for x, y in points if (x, y) != p)
    gaps = [b - a for a, b in zip(angles, angles[1:] + [angles[0] + 2 * math.pi], strict=True)]
    return max(gaps) <= math.pi + 1e-9


def test_hull_point_lies_inside(spark):
    rng = random.Random(3)
    groups = {f"{n}/{k}": [(rng.randint(0, 6) / 3, rng.randint(0, 6) / 3) for _ in range(n)] for n in (1, 2, 3, 5, 40) for k in range(12)}
    groups["line"] = [(i / 7, i / 7) for i in range(20)]
    groups["upright"] = [(1.0, i / 7) for i in range(20)]
    groups["many"] = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(3000)]
    rows = [(g, x, y) for g, points in groups.items() for x, y in points]
    df = spark.createDataFrame(rows, "pba3_block string, longitude double, latitude double")
    for strip in (0.001, 0.5):
        got = {r.pba3_block: (r.longitude, r.latitude) for r in spatial.hull_centers(df, strip).collect()}
        assert set(got) == set(groups)
        for g, points in groups.items():
            assert got[g] == points[0] if len(set(points)) == 1 else in_hull(points, got[g]), (g, got[g])
    assert got["upright"] == (1.0, 19 / 14) and abs(got["line"][0] - 19 / 14) < 1e-12


def test_block_map_override(spark):
    centers = spark.createDataFrame([("A", 0.5, 0.5), ("B", 7.0, 7.0), ("C", 2.5, 0.5)], "pba3_block string, longitude double, latitude double")
    got = spatial.block_map(polygons(spark), centers, 0.5, {"A": 3})
    assert {(r.pba2_block, r.pba3_block) for r in got.collect()} == {(3, "A"), (2, "C")}


def test_hull_centers_drop_the_missing_block(spark):
    df = spark.createDataFrame(
        [("A", "1", 0.0, 0.0), ("A", "2", 2.0, 0.0), ("A", "3", 1.0, 2.0), ("A", "4", 1.0, 0.5), (None, "5", 9.0, 9.0)],
        "pba3_block string, checklist_id string, longitude double, latitude double",
    )
    got = spatial.hull_centers(df).collect()
    assert [(r.pba3_block, r.longitude, r.latitude) for r in got] == [("A", 1.0, 1.0)]


def test_adaptive_cells_agree_and_stay_small(spark):
    """Nine of ten points in one cell, many of them in one place; no key of the join holds more than its share."""
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from gridsurvey.operators import spatial

    r = random.Random(6)
    where = [(r.uniform(0, 4), r.uniform(-2, 2)) for _ in range(300)] + [(1.0 + r.random() / 64, 1.0 + r.random() / 64) for _ in range(2000)]
    where += [(1.001, 1.001)] * 700 + [(None, 1.0), (1.0, None), (2.0, 0.0), (-3.0, 5.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(where)], "checklist_id int, longitude double, latitude double")
    boxes = [(k, x, y, w) for k, (x, y, w) in enumerate(
        [(0, -2, 2), (2, 0, 2), (1, 1, 1 / 128), (1 + 1 / 128, 1, 1 / 128), (1, 1, 1 / 4096), (-8, -8, 20), (9, 9, 1)])]
    ring = lambda x, y, w: [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]
    polygons = spark.createDataFrame([(k, ring(x, y, w)) for k, x, y, w in boxes], "pba2_block int, ring array<struct<x: double, y: double>>")
    pairs = [(k, i) for k, x, y, w in boxes for i, (px, py) in enumerate(where)
             if px is not None and py is not None and x <= px <= x + w and y <= py <= y + w]
    expected = sorted(pairs + [(k, None) for k in {b[0] for b in boxes} - {k for k, _ in pairs}], key=str)
    for levels, most in ((8, 50), (2, 50), (8, 10_000)):
        seen = {}

        def keep(name, df):
            seen[name] = df
            return df

        got = spatial.join_covering_adaptive(polygons, points, "pba2_block", 1.0, levels=levels, most=most, keep=keep)
        assert sorted(map(tuple, got.select("pba2_block", "checklist_id").collect()), key=str) == expected, (levels, most)
        sizes = Counter({tuple(x[:4]): x[4] for x in seen["point_leaves"].groupBy("level", "cx", "cy", "part").agg(F.count("*")).collect()})
        assert sum(sizes.values()) == len(where) - 2
        if levels == 8:  # leaves hold no more; parts of a place are dealt by hash and so about as much
            assert max(n for k, n in sizes.items() if k[0] < 8) <= most and max(sizes.values()) <= 2 * most
    assert spatial.join_covering_adaptive(polygons, points.limit(0), "pba2_block", 1.0).count() == len(boxes)
    assert spatial.join_covering_adaptive(polygons.limit(0), points, "pba2_block", 1.0).count() == 0


def test_adaptive_levels_are_joined_once(spark):
    """However deep the tree, a kept level of the polygons holds one join and the pairs hold one more."""
    from gridsurvey.operators import spatial

    points = spark.createDataFrame([(i, 1.0 + i % 2 / 4096, 1.0) for i in range(60)], "checklist_id int, longitude double, latitude double")
    polygons = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], "pba2_block int, ring array<struct<x: double, y: double>>")
    joins = {}

    def keep(name, df):
        joins[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return df.localCheckpoint()

    assert spatial.join_covering_adaptive(polygons, points, "pba2_block", 1.0, levels=10, most=5, keep=keep).count() == 60
    levels = [n for name, n in joins.items() if name.startswith("polygon_cells")]
    assert len(levels) == 11 and max(levels) == 1 and joins["covered_points"] == 1
