"""Sinks."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import is_clockwise, ring_parts
from . import shapefile


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, in folders of ``partition_by`` if given.

    Rows are then dealt out by folder first, in parts that adaptive execution
    cuts to a fixed size: a task sorts one such part by folder, not its share of
    the table on top of the sorts of the joins before.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, as_text: bool = False) -> None:
    """CSV with a header; ``as_text`` casts every column to text first."""
    out = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]) if as_text else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "").csv(path)


def write_text_scalar(df: DataFrame, path: str) -> None:
    """A one-column, one-row frame as a one-line text."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_polygons(df: DataFrame, path: str, id_property: str) -> None:
    """(pba2_block, ring or rings) as one GeoJSON feature per line.

    A ring inside an odd number of other rings is a hole of the smallest of
    them, every other ring is a part of its own; one part makes a polygon,
    several make a multipolygon. Rings that only touch are not nested.
    """
    rings = F.col("rings") if "rings" in df.columns else F.array("ring")
    parts = df.withColumn("parts", ring_parts(rings))
    points = F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(p.x, p.y))))
    single = F.size("parts") == 1
    # One struct type cannot hold both depths of coordinates, so the geometry is written as text.
    geometry = F.when(single, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(points, 0).alias("coordinates")))).otherwise(
        F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), points.alias("coordinates"))))
    properties = F.to_json(F.struct(F.col("pba2_block").cast("string").alias(id_property)))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}"))
    parts.select(feature.alias("value")).write.mode("overwrite").text(path)


def write_shapefile(df: DataFrame, path: str, append: bool = False) -> None:
    """``rings`` as polygons and the other columns as attributes, in one set of files per task.

    Outlines run clockwise and holes counter-clockwise; which ring is which is
    told as in :func:`write_polygons`. Null or no rings are a missing shape.
    Empty texts and blanks at the ends of texts do not come back. Names over 10
    letters and texts over 254 bytes are refused, not cut.
    """
    df.sparkSession.dataSource.register(shapefile.Shapefile)
    parts = F.transform(ring_parts(F.col("rings")), lambda part: F.transform(part, lambda ring, i: F.when(
        is_clockwise(ring) == (i == 0), ring).otherwise(F.reverse(ring))))
    out = df.withColumn("rings", F.when(F.size("rings") > 0, F.flatten(parts)))
    out.write.format("shapefile").mode("append" if append else "overwrite").save(path)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written under ``path`` in buckets of ``key``, sorted by it, and read back by its bucketing.

    Grouping and joining by the key then need no exchange. One shuffle brings
    each bucket into one file, or one for each folder of ``partition_by``.
    """
    name = _table_name(path)
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, key: str, buckets: int, partition_by: list[str] | None = None) -> DataFrame:
    """A table of ``write_bucketed`` in another session; the catalog of a session forgets how files are bucketed."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    folders = f"PARTITIONED BY ({', '.join(partition_by)}) " if partition_by else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') {folders}CLUSTERED BY ({key}) INTO {buckets} BUCKETS")
    if partition_by:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def _table_name(path: str) -> str:
    return f"bucketed_{md5(path.encode()).hexdigest()}"
