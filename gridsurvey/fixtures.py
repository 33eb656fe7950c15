"""Adapter: the survey's tables as views over a star-schema test set.

One line item is one sighting, its order the checklist, the customer's nation
the block. Only integer arithmetic and plain string functions are used, so
any SQL engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.categories import description_of_rank
from .functions.times import month_label
from .lookups import WEEKS
from .operators.prep import with_rank
from .operators.reshape import pivot_fixed
from .session import scratch_path
from .sources.readers import read_parquet
from .sources.writers import write_bucketed, write_parquet

_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file footer once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = read_parquet(spark, path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and customer columns: one row per checklist."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, cust, order = F.col("c_nationkey"), F.col("o_custkey"), F.col("o_orderkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        order,
        F.col("o_orderdate"),
        F.col("o_orderstatus").alias("protocol_name"),
        F.when(nation != 24, _text("B", F.lpad(nation.cast("string"), 2, "0"))).alias("pba3_block"),
        (F.lit(-80.5) + (cust % 600) / 100).alias("longitude"),
        (F.lit(39.7) + (cust % 250) / 100).alias("latitude"),
    )


def _start(order: Column, line: Column) -> Column:
    """Wall-clock start: the order's hour, and up to 2 minutes of disagreement on every tenth checklist."""
    minutes = (order % 24) * 60 + F.when(order % 10 == 0, line % 3).otherwise(0)
    return F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def _lines(spark: SparkSession, sf_dir: str, species: bool = True) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(
        _checklists(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")
    )
    if not species:
        return lines
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("common_name"))
    return lines.join(names, F.col("l_partkey") == F.col("p_partkey"))


def _count_text(supp: Column) -> Column:
    """``X`` for a tenth, missing for a tenth, else a number."""
    return F.when(supp % 10 == 0, "X").when(supp % 10 != 1, (supp % 50).cast("string"))


def sightings(spark: SparkSession, sf_dir: str, species: bool = True, ranked: bool = True, stored: bool = False) -> DataFrame:
    """Processed sightings. ``species=False`` leaves out the species name and its join.

    ``stored=True`` writes them once and gives the written table, for jobs that
    read them at several grains: the joins are then run once, not once a grain.
    """
    order, line, supp, quantity = (F.col(c) for c in ("o_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    day = F.to_date("o_orderdate")
    names = ["common_name"] if species else []
    df = _lines(spark, sf_dir, species).select(
        order.cast("string").alias("checklist_id"),
        "pba3_block",
        *names,
        _text("obs", (supp % 7).cast("string"), ",obs", (line % 5).cast("string")).alias("observer_id"),
        F.when(line % 5 != 0, _text("C", (line % 5).cast("string"))).otherwise("C1").alias("breeding_category"),
        day.alias("observation_date"),
        month_label(day).alias("observation_month"),
        F.when(quantity >= 3, _start(order, line)).alias("observation_datetime"),
        F.when(quantity <= 45, quantity * 6).alias("duration_minutes"),
        (F.col("l_discount") * 100).alias("effort_distance_km"),
        "longitude",
        "latitude",
        "protocol_name",
        _count_text(supp).alias("observation_count"),
    )
    df = with_rank(df) if ranked else df
    if not stored:
        return df
    path = scratch_path(spark, "sightings")
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sightings written once in buckets of checklists, as the refresh keeps them."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return write_bucketed(sightings(spark, sf_dir), scratch_path(spark, "sightings"), "checklist_id", buckets)


def raw_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they come from the source: copies of shared checklists, sub-species, untrimmed codes."""
    order, line, supp, quantity = (F.col(c) for c in ("o_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    taxa = F.array(*[F.lit(t) for t in ("species", "issf", "form", "spuh", "domestic")])
    projects = F.array(F.lit("Grid Survey"), F.lit("Backyard Count, Grid Survey"), F.lit("Backyard Count"))
    return _lines(spark, sf_dir).select(
        _text("S", order.cast("string"), "-", (supp % 3).cast("string")).alias("event_id"),
        F.when(order % 3 != 0, _text("G", order.cast("string"))).alias("group_id"),
        _text("obs", (supp % 7).cast("string")).alias("observer_id"),
        "common_name",
        F.get(taxa, (F.col("l_partkey") % 5).cast("int")).alias("taxon_category"),
        F.when(line % 5 != 0, _text("  ", F.col("l_returnflag"), "  ", F.col("l_linestatus"), " ")).alias(
            "breeding_code"
        ),
        F.when(line % 5 != 0, _text(F.when(supp % 2 == 0, " ").otherwise(""), "C", (line % 5).cast("string"), " ")).alias(
            "breeding_category"
        ),
        F.to_date("o_orderdate").alias("observation_date"),
        F.when(quantity >= 3, F.date_format(_start(order, line), "HH:mm:ss")).alias("time_observations_started"),
        F.when(quantity <= 45, quantity * 6).alias("duration_minutes"),
        (F.col("l_discount") * 100).alias("effort_distance_km"),
        "longitude",
        "latitude",
        F.col("pba3_block").alias("atlas_block"),
        F.get(projects, (supp % 3).cast("int")).alias("project_names"),
        "protocol_name",
        _count_text(supp).alias("observation_count"),
    )


def _species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("common_name")).distinct()


def nocturnal_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _species(spark, sf_dir).filter(F.length("common_name") % 4 == 0)


def focal_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _species(spark, sf_dir).filter(F.length("common_name") % 3 == 0).withColumn("is_focal", F.lit(True))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block names; every sixth nation is left out, so defaults are needed."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).filter(key % 6 != 5).select(
        _text("B", F.lpad(key.cast("string"), 2, "0")).alias("pba3_block"),
        F.col("n_name").alias("block_name"),
        F.col("r_name").alias("block_region"),
        _text("County ", (key % 7).cast("string")).alias("block_county"),
    )


def old_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old survey, long: (block, species, category description)."""
    rows = _lines(spark, sf_dir).filter("l_returnflag = 'R' and l_partkey % 5 = 0")
    rank = F.max(1 + F.col("l_linenumber") % 4)
    return rows.groupBy("pba3_block", "common_name").agg(rank.alias("rank")).select(
        "pba3_block", "common_name", description_of_rank(F.col("rank")).alias("breeding_category_desc")
    )


def old_survey_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old survey, wide: one row per block, one column per species.

    A matrix has its species in its header, so their names are read first.
    """
    names = [r.common_name for r in _species(spark, sf_dir).orderBy("common_name").collect()]
    rows = _lines(spark, sf_dir).filter("l_returnflag = 'R'")
    wide = pivot_fixed(rows, ["pba3_block"], "common_name", names, F.max(1 + F.col("l_linenumber") % 4))
    return wide.select("pba3_block", *[description_of_rank(F.col(f"`{n}`")).alias(n) for n in names])


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed half-degree square per cell holding a checklist, numbered by cell."""
    cells = _checklists(spark, sf_dir).select(
        F.floor(F.col("longitude") * 2).alias("i"), F.floor(F.col("latitude") * 2).alias("j")
    ).distinct()
    corner = lambda dx, dy: F.struct(((F.col("i") + dx) / 2).alias("x"), ((F.col("j") + dy) / 2).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    number = F.row_number().over(Window.orderBy("i", "j"))  # a fixed grid of at most 72 cells
    return cells.select(number.alias("pba2_block"), ring.alias("ring"))


def calendar_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw calendar row per species: order, starred name, four day-month texts, 48 codes."""
    df = _lines(spark, sf_dir).withColumn("day", F.to_date("o_orderdate"))
    quarter = F.least(F.lit(4), F.floor((F.dayofmonth("day") - 1) / 8) + 1)
    df = df.withColumn("week", _text(F.date_format("day", "MMM"), " ", quarter.cast("string")))
    codes = pivot_fixed(df, ["common_name"], "week", WEEKS, F.count(F.lit(1)))
    letters = F.array(*[F.lit(c) for c in ("", "B", "E", "M", "N")])
    dates = df.groupBy("common_name").agg(
        F.min("l_partkey").alias("taxonomic_order"),
        *[
            F.date_format(F.date_add(F.min("day"), n), "d-MMM").alias(name)
            for n, name in ((20, "s1"), (10, "s2"), (200, "s3"), (190, "s4"))
        ],
    )
    starred = F.when(F.length("common_name") % 3 == 0, _text(F.col("common_name"), "*")).otherwise(F.col("common_name"))
    return dates.join(codes, "common_name").select(
        "taxonomic_order",
        starred.alias("common_name"),
        "s1",
        F.when(F.length("common_name") % 4 == 0, "none").otherwise(F.col("s2")).alias("s2"),
        "s3",
        "s4",
        *[F.get(letters, (F.col(w) % 5).cast("int")).alias(w) for w in WEEKS],
    )
