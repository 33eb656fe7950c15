"""Sources. Schemas are declared: nothing is inferred by reading the data twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shapefile


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Lazy scan; filters and column choices of later operators reach it."""
    return spark.read.parquet(path)


def read_csv(
    spark: SparkSession, path: str, schema: str, header: bool = True, skip: int = 0, multi_line: bool = False
) -> DataFrame:
    """CSV without the first ``skip`` lines of each file, nor the header line after them if there is one.

    Lines are left out by their place in their file, whatever they say, so a
    later line with the same text stays. Files stay splittable, and nothing is
    read while the frame is built. ``multi_line`` reads quoted line breaks,
    for which a file is not split; ``skip`` then counts records.
    """
    reader = spark.read.schema(schema)
    if not skip:
        return reader.option("header", header).option("multiLine", multi_line).csv(path)
    place = [F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__id")]
    start = F.col("_metadata.file_block_start")
    if multi_line:
        rows = reader.option("multiLine", True).csv(path)
        numbered = rows.select(*rows.columns, *place, F.lit(True).alias("__top"))
    else:
        numbered = spark.read.text(path).select("value", *place, (start == 0).alias("__top"))
    # One row per file: the driver lists every file anyway.
    tops = F.broadcast(
        numbered.filter("__top").groupBy("__file").agg(F.min("__id").alias("__first")).withColumnRenamed("__file", "__of")
    )
    kept = numbered.join(tops, F.col("__file") == F.col("__of"), "left").filter(
        ~F.col("__top") | (F.col("__id") - F.col("__first") >= skip + int(header))
    )
    if multi_line:
        return kept.select(*rows.columns)
    return kept.select(F.from_csv("value", schema).alias("r")).select("r.*")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-delimited checklist dump with a header; quotes are ordinary characters."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).csv(path)


def read_text_scalar(spark: SparkSession, path: str, name: str = "release") -> DataFrame:
    """A one-line text artefact as a one-row frame."""
    return spark.read.text(path).select(F.trim("value").alias(name))


GEOJSON = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "geometry",
            # The depth of the coordinates depends on the type, so they are read as text first.
            T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]),
        ),
    ]
)


def read_polygons(spark: SparkSession, path: str, id_property: str, out: str = "pba2_block", collection: bool = False) -> DataFrame:
    """Block polygons from GeoJSON: id, outer ring of the first part, and all rings of all parts.

    One feature per line is the splittable form; ``collection`` reads whole
    FeatureCollection documents. Holes and further parts are rings like any
    other: the even-odd rule of :func:`~gridsurvey.operators.spatial.covers`
    tells inside from outside.
    """
    if collection:
        whole = T.StructType([T.StructField("features", T.ArrayType(GEOJSON))])
        features = spark.read.schema(whole).option("multiLine", True).json(path).select(F.inline("features"))
    else:
        features = spark.read.schema(GEOJSON).json(path)
    text = F.col("geometry.coordinates")
    parts = F.when(
        F.col("geometry.type") == "MultiPolygon", F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    ).otherwise(F.from_json(text, "array<array<array<double>>>"))
    rings = F.transform(
        parts, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    )
    block = F.element_at("properties", id_property).cast("int")
    return features.select(block.alias(out), rings.alias("rings")).select(
        out, F.get("rings", F.lit(0)).alias("ring"), "rings"
    )


def read_shapefile(spark: SparkSession, path: str, partition_bytes: int | None = None, encoding: str = "utf-8") -> DataFrame:
    """Attributes and ``rings`` of the polygons in a shapefile or a folder of them, in ranges of records; missing shapes have null rings."""
    spark.dataSource.register(shapefile.Shapefile)
    reader = spark.read.format("shapefile").option("encoding", encoding)
    return (reader.option("partitionBytes", partition_bytes) if partition_bytes else reader).load(path)
