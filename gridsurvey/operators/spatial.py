"""Points, polygons and the polygon-to-block mapping, without a geometry engine.

A polygon is ``ring``: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, or, with holes and
several parts, ``rings``: an array of such rings; a point is two double
columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import mercator_x, mercator_y
from ..lookups import BLOCK_OVERRIDES
from .metrics import BLOCK

#: Metres from the centre to the surface of the sphere on which ground distances are taken.
EARTH_RADIUS = 6371010.0
#: Degrees of longitude; narrower gaps do not split an extent.
FINEST_GAP = 0.01


def as_point(df: DataFrame, x: str = "longitude", y: str = "latitude", srid: int = 4326) -> DataFrame:
    """A point struct with its reference system."""
    return df.withColumn("point", F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(srid).alias("srid")))


def to_mercator(df: DataFrame, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Add web-mercator metres."""
    return df.withColumns({"x_m": mercator_x(F.col(x)), "y_m": mercator_y(F.col(y))})


def bounding_box(df: DataFrame, x: str, y: str, buffer: float = 0.0) -> DataFrame:
    """Extent of a set of points, widened by a buffer."""
    return df.agg(
        (F.min(x) - buffer).alias("xmin"),
        (F.min(y) - buffer).alias("ymin"),
        (F.max(x) + buffer).alias("xmax"),
        (F.max(y) + buffer).alias("ymax"),
    )


def ground_extent(df: DataFrame, x: str, y: str, metres: float = 0.0, groups: list[str] | None = None) -> DataFrame:
    """(groups, xmin, ymin, xmax, ymax): extent in degrees of all that lies within ``metres`` of a group's points.

    Distances are on a sphere. ``xmin`` and ``xmax`` are the ends of the
    smallest arc of longitudes that holds the circles around all points, so
    ``xmin > xmax`` if it crosses the date line. A group with a circle that
    reaches a pole spans all longitudes, as does one whose circles leave no gap
    of ``FINEST_GAP``. Points that lack a coordinate or lie off the globe are not
    looked at; without groups no points give one row of nulls.

    The arcs of a group are reduced to one per ``FINEST_GAP`` of longitude before
    the window, which so holds at most 36,000 rows: a wider gap always lies
    between two of them.
    """
    groups = groups or []
    radius = float(metres) / EARTH_RADIUS
    lon, lat = F.col(x).cast("double"), F.col(y).cast("double")
    polar = F.abs(lat) + math.degrees(radius) >= 90
    half = F.degrees(F.asin(F.lit(math.sin(radius)) / F.cos(F.radians(lat))))
    arcs = df.filter(lon.between(-360, 360) & lat.between(-90, 90)).select(
        *groups,
        lat.alias("__lat"),
        F.when(polar, -180.0).otherwise(F.pmod(lon - half + 180, F.lit(360.0)) - 180).alias("__west"),
        F.when(polar, 360.0).otherwise(2 * half).alias("__width"),
    )
    cells = arcs.groupBy(*groups, F.floor(F.col("__west") / FINEST_GAP).alias("__cell")).agg(
        F.min("__west").alias("__west"),
        F.max(F.col("__west") + F.col("__width")).alias("__east"),
        F.min("__lat").alias("__south"),
        F.max("__lat").alias("__north"),
    )
    group = Window.partitionBy(*groups)
    before = F.max("__east").over(group.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    ends = cells.withColumn("__end", F.greatest(before, F.max("__east").over(group) - 360))
    widest = ends.withColumn("__gap", F.col("__west") - F.col("__end")).groupBy(*groups).agg(
        F.max_by(F.struct("__west", "__end"), F.struct(F.col("__gap"), -F.col("__west"))).alias("__arc"),
        F.max("__gap").alias("__gap"),
        F.greatest(F.min("__south") - math.degrees(radius), F.lit(-90.0)).alias("ymin"),
        F.least(F.max("__north") + math.degrees(radius), F.lit(90.0)).alias("ymax"),
    )
    whole, end = F.col("__gap") < FINEST_GAP, F.col("__arc.__end")
    return widest.select(
        *groups,
        F.when(whole, -180.0).otherwise(F.col("__arc.__west")).alias("xmin"),
        "ymin",
        F.when(whole, 180.0).when(end <= -180, end + 360).when(end > 180, end - 360).otherwise(end).alias("xmax"),
        F.when(F.col("__gap").isNotNull(), F.col("ymax")).alias("ymax"),
    ).withColumn("ymin", F.when(F.col("xmin").isNotNull(), F.col("ymin")))


def _ring_edges(ring: Column) -> Column:
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(
        F.concat(ring, F.array(F.element_at(ring, 1)))
    )
    return F.zip_with(
        F.slice(closed, F.lit(1), F.size(closed) - 1),
        F.slice(closed, F.lit(2), F.size(closed) - 1),
        lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")),
    )


def covers(rings: Column, x: Column, y: Column) -> Column:
    """True where the area or boundary of the rings holds the point (even-odd rule over all rings, no division)."""
    edges = F.flatten(F.transform(rings, _ring_edges))

    def side(e: Column) -> Column:
        return (e.x2 - e.x1) * (y - e.y1) - (x - e.x1) * (e.y2 - e.y1)

    def on_edge(e: Column) -> Column:
        return (
            (side(e) == 0)
            & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2))
            & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))
        )

    def crosses(e: Column) -> Column:
        spans = (e.y1 > y) != (e.y2 > y)
        return spans & F.when(e.y2 > e.y1, side(e) > 0).otherwise(side(e) < 0)

    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def _area(ring: Column) -> Column:
    return F.abs(F.aggregate(_ring_edges(ring), F.lit(0.0), lambda sum_, e: sum_ + e.x1 * e.y2 - e.x2 * e.y1)) / 2


def is_clockwise(ring: Column) -> Column:
    """True for a ring whose area lies to the right of its edges."""
    return F.aggregate(_ring_edges(ring), F.lit(0.0), lambda sum_, e: sum_ + e.x1 * e.y2 - e.x2 * e.y1) < 0


def ring_parts(rings: Column) -> Column:
    """Rings as parts: an array of arrays whose first ring is an outline and whose others are its holes.

    A ring is inside another if its area is smaller and all its vertices are in
    the other or on its boundary.
    """
    numbered = F.transform(rings, lambda r, i: F.struct(i.alias("i"), r.alias("ring"), _area(r).alias("area")))

    def around(r: Column) -> Column:
        return F.filter(numbered, lambda o: (o.area > r.area) & F.forall(r.ring, lambda p: covers(F.array(o.ring), p.x, p.y)))

    nested = F.transform(numbered, lambda r: F.struct(
        r.i.alias("i"), r.ring.alias("ring"), (F.size(around(r)) % 2 == 1).alias("hole"),
        F.array_min(F.transform(around(r), lambda o: F.struct(o.area, o.i))).getField("i").alias("of")))
    outlines = F.filter(nested, lambda r: ~r.hole)
    return F.transform(outlines, lambda o: F.concat(
        F.array(o.ring), F.transform(F.filter(nested, lambda h: h.hole & (h.of == o.i)), lambda h: h.ring)))


def join_covering(
    polygons: DataFrame,
    points: DataFrame,
    polygon_id: str,
    cell: float,
    x: str = "longitude",
    y: str = "latitude",
    salts: int = 4,
) -> DataFrame:
    """Left spatial join: each polygon with every point it covers, null where none.

    Polygons are exploded into the grid cells of their bounding box, points
    fall into one cell each, and the join is an equi-join on the cell, checked
    by bounding box and exact test. A point meets a polygon in one cell only,
    so no pair repeats. A crowded cell is spread over ``salts`` tasks by the
    point's hash against copies of the cell's polygons. Polygons without a
    point are added by an anti-join on the distinct ids found, so a polygon
    holding many points never brings them into one task.
    """
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    xs, ys = (F.transform(F.flatten(rings), lambda p: p[axis]) for axis in ("x", "y"))
    boxed = polygons.select(
        *polygons.columns,
        F.array_min(xs).alias("x0"),
        F.array_max(xs).alias("x1"),
        F.array_min(ys).alias("y0"),
        F.array_max(ys).alias("y1"),
    )
    gridded = (
        boxed.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))))
        .withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    placed = points.withColumns(
        {
            "cx": F.floor(F.col(x) / cell),
            "cy": F.floor(F.col(y) / cell),
            "salt": F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"),
        }
    )
    px, py = F.col(x), F.col(y)
    pairs = (
        gridded.join(placed, ["cx", "cy", "salt"], "inner")
        .filter(px.between(F.col("x0"), F.col("x1")) & py.between(F.col("y0"), F.col("y1")))
        .filter(covers(rings, px, py))
        .select(*polygons.columns, *points.columns)
    )
    unmatched = polygons.join(pairs.select(polygon_id).distinct(), polygon_id, "left_anti")
    return pairs.unionByName(unmatched, allowMissingColumns=True)


#: Times a root cell may be halved, and points and polygon vertices in one cell before it is.
LEVELS = 16
MOST_IN_CELL = 20_000


def _cell(value: Column, cell: float, level: int) -> Column:
    return F.floor(value / (cell / (1 << level))).cast("bigint")


def crowded_cells(points: DataFrame, polygons: DataFrame, cell: float, x: str, y: str, levels: int, most: int) -> DataFrame:
    """(level, cx, cy, n): the cells of a quadtree with more than ``most`` points and polygon vertices.

    Counted once at the finest level, which combines on the map side, and
    rolled up from there. Crowded cells have crowded parents, so a point lies
    in the leaf one level below its last crowded cell.
    """
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    corners = polygons.select(F.explode(F.flatten(rings)).alias("p")).select(F.col("p.x").alias("__x"), F.col("p.y").alias("__y"))
    places = points.select(F.col(x).alias("__x"), F.col(y).alias("__y")).unionByName(corners)
    finest = places.dropna().groupBy(_cell(F.col("__x"), cell, levels).alias("fx"), _cell(F.col("__y"), cell, levels).alias("fy")).agg(
        F.count("*").alias("n"))
    above = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    back = F.lit(levels) - F.col("level")
    moved = [F.call_function("shiftright", F.col(c), back).alias(to) for c, to in (("fx", "cx"), ("fy", "cy"))]
    return above.select("level", *moved, "n").groupBy("level", "cx", "cy").agg(F.sum("n").alias("n")).filter(F.col("n") > most)


def join_covering_adaptive(
    polygons: DataFrame,
    points: DataFrame,
    polygon_id: str,
    cell: float,
    x: str = "longitude",
    y: str = "latitude",
    levels: int = LEVELS,
    most: int = MOST_IN_CELL,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> DataFrame:
    """``join_covering`` over cells that follow the data, for points of any number and crowding.

    Cells of a quadtree are halved until they hold at most ``most`` points and
    vertices. Polygons go down the same tree, only through cells their bounding
    box meets. A cell still crowded at the last level, where points all but
    coincide, is spread over as many parts as it needs. The join is an equi-join
    on leaf and part, so no key holds more than ``most`` points. ``keep`` may
    write and reread the crowded cells, the leaves of the points, the polygons'
    cells of each level and the pairs, which are read more than once; without
    it the cells of a level are found anew for every level below, in one task's
    memory. Points without coordinates meet nothing.
    """
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    xs, ys = (F.transform(F.flatten(rings), lambda p: p[axis]) for axis in ("x", "y"))
    crowded = keep("crowded_cells", crowded_cells(points, polygons, cell, x, y, levels, most))
    deepest = crowded.agg(F.max("level")).first()[0]
    deepest = -1 if deepest is None else deepest
    key = ["level", "cx", "cy"]

    # Points: down the tree together with the crowded cells, level by level; all but the last are settled by a left join.
    here = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({
        "level": F.lit(0), "parts": F.lit(1).cast("bigint")})
    for level in range(deepest + 1):
        at = crowded.filter(F.col("level") == level).select(
            F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.ceil(F.col("n") / most).cast("bigint").alias("__parts"))
        meets = (F.col("level") == level) & (_cell(F.col(x), cell, level) == F.col("__cx")) & (_cell(F.col(y), cell, level) == F.col("__cy"))
        found = F.col("__cx").isNotNull()
        deeper = {"level": F.when(found, level + 1).otherwise(F.col("level"))} if level < levels else {
            "parts": F.when(found, F.col("__parts")).otherwise(F.col("parts"))}
        here = here.join(at, meets, "left").withColumns(deeper).drop("__cx", "__cy", "__parts")
    scale = F.pow(F.lit(2.0), F.col("level")) / F.lit(cell)
    leaves = keep("point_leaves", here.withColumns({
        "cx": F.floor(F.col(x) * scale).cast("bigint"), "cy": F.floor(F.col(y) * scale).cast("bigint"),
        "part": F.pmod(F.xxhash64(*points.columns), F.col("parts"))}).drop("parts"))

    boxed = polygons.select(*polygons.columns, F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"),
                            F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    at = boxed.withColumns({"level": F.lit(0), "parts": F.lit(1).cast("bigint")})
    at = at.withColumn("cx", F.explode(F.sequence(_cell(F.col("x0"), cell, 0), _cell(F.col("x1"), cell, 0))))
    at = at.withColumn("cy", F.explode(F.sequence(_cell(F.col("y0"), cell, 0), _cell(F.col("y1"), cell, 0))))
    settled = []
    for level in range(deepest + 1):
        full = crowded.filter(F.col("level") == level).select("cx", "cy", F.ceil(F.col("n") / most).cast("bigint").alias("__parts"))
        told = keep(f"polygon_cells_{level}", at.join(full, ["cx", "cy"], "left"))
        if level == levels:
            at = told.withColumn("parts", F.coalesce("__parts", "parts")).drop("__parts")
            break
        settled.append(told.filter("__parts is null").drop("__parts").select(*boxed.columns, *key, "parts"))
        size = cell / (1 << (level + 1))
        child = told.filter("__parts is not null").drop("__parts").withColumn("level", F.lit(level + 1))
        for c, lo, hi in (("cx", "x0", "x1"), ("cy", "y0", "y1")):
            # The halves that the box meets.
            first = F.greatest(2 * F.col(c), F.floor(F.col(lo) / size).cast("bigint"))
            last = F.least(2 * F.col(c) + 1, F.floor(F.col(hi) / size).cast("bigint"))
            child = child.filter(first <= last).withColumn(c, F.explode(F.sequence(first, last)))
        at = child
    settled.append(at.select(*boxed.columns, *key, "parts"))
    gridded = reduce(lambda a, b: a.unionByName(b), settled)
    gridded = gridded.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")

    px, py = F.col(x), F.col(y)
    pairs = keep("covered_points", (
        gridded.join(leaves, [*key, "part"], "inner")
        .filter(px.between(F.col("x0"), F.col("x1")) & py.between(F.col("y0"), F.col("y1")))
        .filter(covers(rings, px, py))
        .select(*polygons.columns, *points.columns)))
    unmatched = polygons.join(pairs.select(polygon_id).distinct(), polygon_id, "left_anti")
    return pairs.unionByName(unmatched, allowMissingColumns=True)


#: Slopes closer than this count as equal, so points on an edge are no vertices.
SAME_SLOPE = 1e-9


def _lower_chain(points: Column) -> Column:
    """Lower convex chain of points sorted by x, with one point per x.

    Each point goes behind the vertex it sees under the largest slope; the
    vertices after that one lie above the new edge and fall away.
    """

    def add(chain: Column, p: Column) -> Column:
        slopes = F.transform(chain, lambda v: (p.y - v.y) / (p.x - v.x))
        numbered = F.transform(slopes, lambda s, i: F.struct(s.alias("s"), (i + 1).alias("at")))
        # The one-element array binds the largest slope, so that it is computed once a point.
        tangent = F.transform(F.array(F.array_max(slopes)), lambda most: F.array_min(
            F.filter(numbered, lambda c: c.s >= most - SAME_SLOPE).getField("at")))[0]
        return F.concat(F.slice(chain, F.lit(1), tangent), F.array(p))

    first = F.slice(points, 1, 1)
    return F.aggregate(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), first, add)


def _hull_ring(columns: Column) -> Column:
    """The hull as a ring of vertices, from (x, least y, largest y) sorted by x."""
    low = _lower_chain(F.transform(columns, lambda c: F.struct(c.x.alias("x"), c.low.alias("y"))))
    flipped = _lower_chain(F.transform(columns, lambda c: F.struct(c.x.alias("x"), (-c.high).alias("y"))))
    high = F.transform(F.reverse(flipped), lambda v: F.struct(v.x.alias("x"), (-v.y).alias("y")))
    return F.array_distinct(F.concat(low, high))


def hull_centers(x: DataFrame, strip: float = 0.001) -> DataFrame:
    """One interior point of the checklists' convex hull per block; the missing block is dropped.

    The point is the middle of the hull's cut by a horizontal line, halfway
    between the hull vertices next above and next below half height, so that
    it never runs through a vertex. A hull without area gives the middle
    between its ends.

    Exact for any number of checklists, in built-in functions: first the least
    and largest latitude per (block, longitude), which combine on the map side
    and keep every vertex; then the hull of each strip of ``strip`` degrees,
    whose points are bounded by the precision of coordinates; then the hull of
    a block's strips, bounded by its width.
    """
    reduced = (
        x.filter(F.col(BLOCK).isNotNull() & F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
        .groupBy(BLOCK, F.col("longitude").alias("x"))
        .agg(F.min("latitude").alias("low"), F.max("latitude").alias("high"))
    )

    def rings(df: DataFrame, *keys) -> DataFrame:
        columns = F.sort_array(F.collect_list(F.struct("x", "low", "high")))
        return df.groupBy(BLOCK, *keys).agg(columns.alias("columns")).withColumn("ring", _hull_ring(F.col("columns")))

    strips = rings(reduced, F.floor(F.col("x") / strip).alias("strip")).select(BLOCK, F.inline("ring"))
    merged = strips.groupBy(BLOCK, "x").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    vertex_y = F.transform("ring", lambda v: v.y)
    leveled = (
        rings(merged).select(BLOCK, "ring", vertex_y.alias("ys"))
        .withColumn("middle", (F.array_min("ys") + F.array_max("ys")) / 2)
        .withColumn("line", (
            F.array_min(F.filter("ys", lambda v: v > F.col("middle"))) + F.array_max(F.filter("ys", lambda v: v <= F.col("middle")))
        ) / 2)
    )
    following = F.concat(F.slice("ring", F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    edges = F.zip_with("ring", following, lambda a, b: F.struct(
        a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))
    line = F.col("line")
    crossing = F.filter(edges, lambda e: (e.y1 > line) != (e.y2 > line))
    cuts = F.transform(crossing, lambda e: e.x1 + (e.x2 - e.x1) * (line - e.y1) / (e.y2 - e.y1))
    ends = F.transform("ring", lambda v: v.x)
    flat = F.size("ring") < 3
    middle_of = lambda values: (F.array_min(values) + F.array_max(values)) / 2
    # One row per block already; the grouping keeps later filters from being
    # rewritten in terms of the whole hull.
    return leveled.withColumn("cuts", cuts).groupBy(BLOCK).agg(
        F.any_value(F.when(flat, middle_of(ends)).otherwise(middle_of(F.col("cuts")))).alias("longitude"),
        F.any_value(F.when(flat, F.col("middle")).otherwise(line)).alias("latitude"),
    )


def block_map(
    polygons: DataFrame, centers: DataFrame, cell: float, overrides: dict[str, int] = BLOCK_OVERRIDES
) -> DataFrame:
    """Old polygon -> new block by covered centre, with corrections by hand.

    A corrected block takes its given old block, and the row of that old block
    left without a new one goes.
    """
    joined = join_covering(polygons, centers, "pba2_block", cell).select(*polygons.columns, BLOCK)
    old = F.col("pba2_block")
    for new_block, old_block in overrides.items():
        old = F.when(F.col(BLOCK) == new_block, F.lit(old_block)).otherwise(old)
    mapped = joined.withColumn("pba2_block", old)
    for old_block in overrides.values():
        mapped = mapped.filter(~((F.col("pba2_block") == old_block) & F.col(BLOCK).isNull()))
    return mapped
