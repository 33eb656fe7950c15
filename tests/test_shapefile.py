"""Shapefiles: round trips of shapes and attributes, ranges of records, files of other programs, repeated writes."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from gridsurvey.sources import readers, writers

SCHEMA = "id bigint, name string, share double, seen boolean, day date, rings array<array<struct<x: double, y: double>>>"


def square(x, y, side, reverse=False):
    x, y, side = float(x), float(y), float(side)
    ring = [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]
    return ring[::-1] if reverse else ring


def rows(df):
    plain = lambda rings: rings and [[tuple(p) for p in ring] for ring in rings]
    return sorted((*r[:-1], plain(r.rings)) for r in df.collect())


def test_round_trip(spark, tmp_path):
    day = datetime.date(2024, 2, 29)
    data = [
        (1, "plain", 0.1, True, day, [square(0, 0, 4)]),
        (2, "höle", -1e300, False, None, [square(0, 0, 4), square(1, 1, 1, reverse=True)]),
        (3, None, None, None, day, [square(0, 0, 1), square(9, 9, 1)]),
        (4, "no shape", 1 / 3, True, day, None),
        (-(2**63), "long", 0.0, True, day, [square(0, 0, 1)]),
    ]
    path = str(tmp_path / "a")
    writers.write_shapefile(spark.createDataFrame(data, SCHEMA).repartition(3), path)
    back = readers.read_shapefile(spark, path)
    assert rows(back) == sorted(data) and [t for _, t in back.dtypes[:-1]] == ["bigint", "string", "double", "boolean", "date"]
    writers.write_shapefile(spark.createDataFrame(data[:1], SCHEMA), path, append=True)
    assert readers.read_shapefile(spark, path).count() == 6
    writers.write_shapefile(spark.createDataFrame(data[1:2], SCHEMA), path)
    assert rows(readers.read_shapefile(spark, path)) == data[1:2]


def test_rings_are_turned(spark, tmp_path):
    """An outline is written clockwise and a hole the other way, however they came."""
    path = str(tmp_path / "a")
    given = [(1, None, None, None, None, [square(1, 1, 1), square(0, 0, 4, reverse=True)])]
    writers.write_shapefile(spark.createDataFrame(given, SCHEMA), path)
    assert rows(readers.read_shapefile(spark, path))[0][-1] == [square(0, 0, 4), square(1, 1, 1, reverse=True)]


def test_many_tasks_read_one_file(spark, tmp_path):
    path = str(tmp_path / "a")
    x = F.col("id") * 2.0
    ring = F.array(*[F.struct((x + dx).alias("x"), F.lit(float(dy)).alias("y")) for dx, dy in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))])
    writers.write_shapefile(spark.range(0, 1000, numPartitions=1).select("id", F.array(ring).alias("rings")), path)
    df = readers.read_shapefile(spark, path, partition_bytes=20_000)
    parts = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()}
    assert len(parts) > 5 and max(parts.values()) < 200
    assert df.filter(F.col("rings")[0][0]["x"] == 2.0 * F.col("id")).distinct().count() == 1000


def test_file_of_another_program(spark, tmp_path):
    """Z shapes, deleted rows, decimals, fills, blanks and another encoding, one file by its name."""
    ring = square(0, 0, 2)
    z = struct.pack("<i4dii", 15, 0, 0, 2, 2, 1, len(ring)) + struct.pack("<i", 0)
    z += b"".join(struct.pack("<2d", *p) for p in ring) + struct.pack(f"<{2 + len(ring)}d", *[7.0] * (2 + len(ring)))
    shapes, shp, shx = [z, struct.pack("<i", 0), z, z], b"", b""
    for i, s in enumerate(shapes, 1):
        shx += struct.pack(">ii", (100 + len(shp)) // 2, len(s) // 2)
        shp += struct.pack(">ii", i, len(s) // 2) + s
    (tmp_path / "x.shp").write_bytes(bytes(100) + shp)
    (tmp_path / "x.shx").write_bytes(bytes(100) + shx)
    fields = b"".join(struct.pack("<11sc4xBB14x", n, k, size, d) for n, k, size, d in [(b"NAME", b"C", 6, 0), (b"N", b"N", 6, 2), (b"K", b"N", 4, 0)])
    table = [b" K\xf6ln    1.50  12", b"          ****   *".ljust(17), b"*gone    2.00   3", b" x       2.00   3"]
    table[1] = b" " + b" " * 6 + b"******" + b"    "
    (tmp_path / "x.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 99, 1, 1, 4, 32 + 96 + 1, 17) + fields + b"\r" + b"".join(table) + b"\x1a")
    df = readers.read_shapefile(spark, str(tmp_path / "x.shp"), encoding="latin-1")
    got = [(r.NAME, r.N, r.K, r.rings is None) for r in df.collect()]
    assert sorted(got, key=str) == sorted([("Köln", 1.5, 12, False), (None, None, None, True), ("x", 2.0, 3, False)], key=str)


def test_refuses_what_it_cannot_hold(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)
    for bad in (df.withColumnRenamed("name", "a_name_too_long"), df.withColumn("name", F.repeat(F.lit("x"), 300)), df.withColumn("name", F.array("id"))):
        with pytest.raises(Exception, match="letters|bytes|attribute"):
            writers.write_shapefile(bad, str(tmp_path / "bad"))
    writers.write_shapefile(df.limit(1), str(tmp_path / "one"))
    assert rows(readers.read_shapefile(spark, str(tmp_path / "one"))) == [(1, None, None, None, None, None)]
