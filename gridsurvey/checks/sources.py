"""Sources and sinks: the tables are written with a sink and read back with a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.text import release_label
from ..operators.spatial import covers
from ..session import scratch_path
from ..sources import readers, writers
from .registry import query, r6, text, with_views


@query(
    "src_parquet",
    "SELECT l_orderkey, l_quantity, l_shipdate::VARCHAR AS shipped FROM lineitem",
)
def src_parquet(spark, sf):
    df = readers.read_parquet(spark, f"{sf}/lineitem.parquet")
    return df.select("l_orderkey", "l_quantity", text("l_shipdate").alias("shipped"))


CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query(
    "src_csv",
    """SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT NULL, 'c_name', NULL, NULL, 'c_mktsegment' FROM customer""",
)
def src_csv(spark, sf):
    """Several files whose title lines are skipped by place: lines with the same text among the data stay."""
    path = scratch_path(spark, "csv")
    rows = fx.table(spark, sf, "customer").select(*fields(CUSTOMER))
    titles = rows.select(*[F.lit(c).alias(c) for c in rows.columns])
    rows = rows.select(*[F.col(c).cast("string") for c in rows.columns])
    writers.write_csv(rows.union(titles).repartition(3), path)
    df = readers.read_csv(spark, path, CUSTOMER, header=False, skip=1)
    return df.withColumn("c_acctbal", r6("c_acctbal"))


def fields(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(",")]


SIGHTING = (
    "checklist_id string, pba3_block string, common_name string, observer_id string, breeding_category string, "
    "observation_date date, observation_month string, observation_datetime timestamp_ntz, duration_minutes double, "
    "effort_distance_km double, longitude double, latitude double"
)


@query(
    "src_tsv",
    with_views(
        """SELECT checklist_id, pba3_block, common_name, observer_id, breeding_category,
  strftime(observation_date, '%Y-%m-%d 00:00:00') AS observation_date, observation_month,
  strftime(observation_datetime, '%Y-%m-%d %H:%M:%S') AS observation_datetime, duration_minutes,
  round(effort_distance_km, 6) AS effort_distance_km, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude
FROM sightings""",
        "sightings",
    ),
)
def src_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    writers.write_tsv(fx.sightings(spark, sf).select(*fields(SIGHTING)), path)
    df = readers.read_tsv(spark, path, SIGHTING)
    return df.withColumns(
        {
            **{c: text(c) for c in ("observation_date", "observation_datetime")},
            **{c: r6(c) for c in ("effort_distance_km", "longitude", "latitude")},
        }
    )


@query("src_text_scalar", "SELECT strftime(max(o_orderdate), '%b-%Y') AS release FROM orders")
def src_text_scalar(spark, sf):
    path = scratch_path(spark, "release")
    latest = fx.table(spark, sf, "orders").agg(F.date_format(F.max("o_orderdate"), "MMM-yyyy"))
    writers.write_text_scalar(latest, path)
    return readers.read_text_scalar(spark, path)


@query(
    "src_polygons",
    with_views(
        """SELECT pba2_block::INTEGER AS pba2_block, 10::BIGINT AS vertices, 2::BIGINT AS rings,
  x0 AS xmin, CASE WHEN pba2_block % 2 = 0 THEN x1 + 100 ELSE x1 END AS xmax, y0 AS ymin, y1 AS ymax,
  pba2_block % 2 = 0 AS middle_covered, pba2_block % 2 = 0 AS second_part_covered
FROM polygons""",
        "polygons",
    ),
)
def src_polygons(spark, sf):
    """Squares, odd ones with a square hole, even ones with a second part 100 degrees to the east."""
    path = scratch_path(spark, "polygons")
    corner = F.element_at("ring", 1)
    square = lambda x, y, side: F.array(*[
        F.array(x + dx * side, y + dy * side) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    whole = square(corner.x, corner.y, 0.5)
    shapes = {
        "Polygon": ("pba2_block % 2 = 1", F.array(whole, square(corner.x + 0.125, corner.y + 0.125, 0.25))),
        "MultiPolygon": ("pba2_block % 2 = 0", F.array(F.array(whole), F.array(square(corner.x + 100, corner.y, 0.5)))),
    }
    blocks = fx.polygons(spark, sf)
    lines = [
        blocks.filter(which).select(F.to_json(F.struct(
            F.lit("Feature").alias("type"), F.struct(F.col("pba2_block").cast("string").alias("BLOCK_ID")).alias("properties"),
            F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"))).alias("value"))
        for kind, (which, coordinates) in shapes.items()
    ]
    lines[0].union(lines[1]).write.text(path)
    df = readers.read_polygons(spark, path, "BLOCK_ID")
    points = F.flatten("rings")
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    x, y = corner.x + 0.25, corner.y + 0.25
    return df.select(
        "pba2_block",
        F.size(points).cast("bigint").alias("vertices"),
        F.size("rings").cast("bigint").alias("rings"),
        F.array_min(xs).alias("xmin"),
        F.array_max(xs).alias("xmax"),
        F.array_min(ys).alias("ymin"),
        F.array_max(ys).alias("ymax"),
        covers(F.col("rings"), x, y).alias("middle_covered"),
        covers(F.col("rings"), x + 100, y).alias("second_part_covered"),
    )


@query(
    "src_shapefile",
    with_views(
        """SELECT pba2_block::BIGINT AS block, 'Block ' || pba2_block::VARCHAR AS label, round(x0 / 2, 6) AS west,
  CASE WHEN pba2_block % 3 <> 0 THEN (x1 - x0) * (y1 - y0) * CASE WHEN pba2_block % 2 = 0 THEN 2 ELSE 0.75 END END::DOUBLE AS area,
  CASE WHEN pba2_block % 3 <> 0 THEN 10 END::BIGINT AS vertices FROM polygons""",
        "polygons",
    ),
)
def src_shapefile(spark, sf):
    """The squares of ``src_polygons``, every third without a shape, written as shapefiles and read in ranges of records."""
    path = scratch_path(spark, "shapes")
    corner = F.element_at("ring", 1)
    square = lambda x, y, side: F.array(*[
        F.struct((x + dx * side).alias("x"), (y + dy * side).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    other = F.when(F.col("pba2_block") % 2 == 0, square(corner.x + 100, corner.y, 0.5)).otherwise(square(corner.x + 0.125, corner.y + 0.125, 0.25))
    shapes = fx.polygons(spark, sf).select(
        F.col("pba2_block").cast("bigint").alias("block"), F.concat(F.lit("Block "), F.col("pba2_block").cast("string")).alias("label"),
        (corner.x / 2).alias("west"), F.when(F.col("pba2_block") % 3 != 0, F.array(square(corner.x, corner.y, 0.5), other)).alias("rings"))
    writers.write_shapefile(shapes, path)
    df = readers.read_shapefile(spark, path, partition_bytes=1024)
    # Outlines run clockwise and holes do not, so the signed areas add up to the area.
    area = F.aggregate("rings", F.lit(0.0), lambda sum_, ring: sum_ - F.aggregate(
        F.zip_with(F.slice(ring, 1, 4), F.slice(ring, 2, 4), lambda a, b: a.x * b.y - b.x * a.y), F.lit(0.0), lambda s, v: s + v) / 2)
    return df.select("block", "label", r6("west").alias("west"), r6(area).alias("area"), F.size(F.flatten("rings")).cast("bigint").alias("vertices"))


@query(
    "sink_polygons",
    with_views(
        """SELECT pba2_block::INTEGER AS pba2_block, CASE WHEN pba2_block % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS n_rings,
  x0 AS xmin, CASE WHEN pba2_block % 2 = 0 THEN x1 + 100 ELSE x1 END AS xmax,
  pba2_block % 2 = 0 AS middle_covered, FALSE AS second_middle_covered, pba2_block % 2 = 0 AS second_rim_covered
FROM polygons""",
        "polygons",
    ),
)
def sink_polygons(spark, sf):
    """Squares written and read back: odd ones with a hole, even ones with a second part that has one."""
    path = scratch_path(spark, "written_polygons")
    corner = F.element_at("ring", 1)
    square = lambda x, y, side: F.array(*[
        F.struct((x + dx * side).alias("x"), (y + dy * side).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    whole, hole = square(corner.x, corner.y, 0.5), square(corner.x + 0.125, corner.y + 0.125, 0.25)
    far = square(corner.x + 100, corner.y, 0.5), square(corner.x + 100.125, corner.y + 0.125, 0.25)
    odd = F.col("pba2_block") % 2 == 1
    # The hole comes before its outline, so that their order tells nothing.
    blocks = fx.polygons(spark, sf).select("pba2_block", F.when(odd, F.array(hole, whole)).otherwise(F.array(far[1], whole, far[0])).alias("rings"))
    writers.write_polygons(blocks, path, "BLOCK_ID")
    df = readers.read_polygons(spark, path, "BLOCK_ID")
    points = F.flatten("rings")
    boxed = df.withColumns({
        "xmin": F.array_min(F.transform(points, lambda p: p.x)), "xmax": F.array_max(F.transform(points, lambda p: p.x)),
        "y": F.array_min(F.transform(points, lambda p: p.y)) + 0.25})
    inside = lambda dx: covers(F.col("rings"), F.col("xmin") + dx, F.col("y"))
    return boxed.select(
        "pba2_block", F.size("rings").cast("bigint").alias("n_rings"), "xmin", "xmax", inside(0.25).alias("middle_covered"),
        inside(100.25).alias("second_middle_covered"), inside(100.0625).alias("second_rim_covered"))


@query(
    "sink_parquet",
    with_views(
        """SELECT observation_month, pba3_block, count(*) AS n, round(sum(duration_minutes), 6) AS minutes
FROM sightings GROUP BY ALL""",
        "sightings",
    ),
)
def sink_parquet(spark, sf):
    """The fact table partitioned by month, read back."""
    path = scratch_path(spark, "sightings")
    writers.write_parquet(fx.sightings(spark, sf), path, ["observation_month"])
    df = readers.read_parquet(spark, path)
    return df.groupBy("observation_month", "pba3_block").agg(
        F.count("*").alias("n"), r6(F.sum("duration_minutes")).alias("minutes")
    )


@query("sink_csv", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderpriority FROM orders")
def sink_csv(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), path, as_text=True)
    return readers.read_csv(spark, path, "o_orderkey string, o_custkey string, o_orderpriority string")


@query(
    "prep_release_date",
    """SELECT strftime(o_orderdate, '%b-%Y') AS release, strftime(last_day(o_orderdate), '%Y-%m-%d') AS release_end,
  count(*) AS extracts FROM orders GROUP BY 1, 2""",
)
def prep_release_date(spark, sf):
    from ..operators.prep import release_end

    orders = fx.table(spark, sf, "orders")
    paths = orders.select(
        F.concat(F.lit("data/extract_rel"), F.date_format("o_orderdate", "MMM-yyyy"), F.lit(".txt")).alias("path")
    )
    labelled = release_end(paths.select(release_label(F.col("path")).alias("release")))
    return labelled.groupBy("release", F.col("release_end").cast("string").alias("release_end")).agg(
        F.count("*").alias("extracts")
    )
