"""Fixed lookup values of the survey data model and their DataFrame forms.

Every frame built here is a local relation of at most 48 rows, so Catalyst
knows its exact size and broadcasts it without a hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values ---------------------------------------------------------
# They must equal the values in the survey data for right results.

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# season -> months; a month may belong to several seasons
SEASONS = {
    "All seasons": ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"],
    "Breeding": ["Apr", "May", "Jun", "Jul", "Aug"],
    "Winter": ["Dec", "Jan", "Feb"],
}

# (breeding_category, breeding_category_desc, breeding_rank)
CATEGORIES = [
    ("0", "Not Observed", 0),
    ("C1", "Observed", 1),
    ("C2", "Possible", 2),
    ("C3", "Probable", 3),
    ("C4", "Confirmed", 4),
]

# names in the old survey -> names in the current taxonomy
SPECIES_RENAMES = {
    "Yellow Warbler": "Northern Yellow Warbler",
    "Warbling Vireo": "Eastern Warbling Vireo",
    "Barn Owl": "American Barn Owl",
    "Herring Gull": "American Herring Gull",
    "Northern Goshawk": "American Goshawk",
    "House Wren": "Northern House Wren",
    "Western Cattle Egret": "Western Cattle-Egret",
}

# category names in the old survey -> current category names
CATEGORY_RENAMES = {"Observed/Possible": "Observed"}

# calendar code -> meaning
CALENDAR_GLOSSARY = [
    ("B", "Breeding season only"),
    ("E", "Either migration or breeding"),
    ("M", "Migration"),
    ("N", "Non-breeding season"),
]

# new block -> old block, where the spatial mapping is corrected by hand
BLOCK_OVERRIDES = {"40075F2SE": 4932}

# completion criteria
COMPLETION_THRESHOLDS = {
    "coded_species": 70,
    "confirmed_share": 0.25,
    "possible_share": 0.25,
    "coded_ratio": 0.8,
    "effort_hours": 20,
    "breeding_months": 3,
    "nocturnal_species": 2,
    "nocturnal_hours": 2,
}

# twilight still counted as day
MINUTES_BEFORE_SUNRISE = 40
MINUTES_AFTER_SUNSET = 20

SURVEY_TZ = "America/New_York"
SURVEY_START = "2024-01-01"

# --- end of fixed values --------------------------------------------------

CATEGORY_NAMES = [desc for _, desc, _ in CATEGORIES]
DAY_NIGHT = ["diurnal", "nocturnal", "unknown"]
WEEKS = [f"{month} {quarter}" for month in MONTHS for quarter in (1, 2, 3, 4)]


def _literal_table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Fixed rows as a local relation, whose size the planner knows; a list handed over as an RDD counts as huge."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def category_table(spark: SparkSession) -> DataFrame:
    """category -> description -> rank (5 rows)."""
    return _literal_table(spark, CATEGORIES, "breeding_category, breeding_category_desc, breeding_rank")


def season_table(spark: SparkSession) -> DataFrame:
    """season -> month, many to many (20 rows)."""
    rows = [(season, month) for season, months in SEASONS.items() for month in months]
    return _literal_table(spark, rows, "season, month")


def season_months(season: str) -> list[str]:
    """Month labels of one season."""
    return list(SEASONS[season])


def glossary_table(spark: SparkSession) -> DataFrame:
    """Calendar code -> meaning (4 rows)."""
    return spark.createDataFrame(CALENDAR_GLOSSARY, "season_code string, description string")
