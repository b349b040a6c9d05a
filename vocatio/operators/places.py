"""Locations by rules: places of a gazetteer table in a raw location, and the one that it stands for.

A gazetteer has one row for each reading of a name: phrase, kind (city, state, country or
placeholder), name, state (a code, null outside the country that is written by states), country,
weight. Names are met as phrases, leftmost and longest first, so whatever else a location holds
(offices, floors, codes) plays no part. What is looked up are distinct locations, by equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.operators.phrases import phrase_spans, words_of

GAZETTEER = "phrase string, kind string, name string, state string, country string, weight double"
HOME = "United States"
UNKNOWN = "Unknown"

# --- fixed values ---

STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
HOME_NAMES = ("United States", "United States of America", "USA", "US", "U.S.", "U.S.A.")
PLACEHOLDERS = ("location", "remote", "hybrid", "global", "anywhere", "various", "multiple locations", "TBD", "N/A", "not specified")


def fixed_places(spark: SparkSession) -> DataFrame:
    """The states by name and code, their country, and words that stand for no place. Cities and other
    countries come from the caller's table."""
    rows = [(p, "state", name, code, HOME, 0.0) for code, name in STATES.items() for p in (code, name)]
    rows += [(p, "country", HOME, None, HOME, 0.0) for p in HOME_NAMES]
    rows += [(p, "placeholder", None, None, None, 0.0) for p in PLACEHOLDERS]
    return spark.createDataFrame(rows, GAZETTEER)


def locations_by_rules(locations: DataFrame, gazetteer: DataFrame, text_col: str = "location") -> DataFrame:
    """text_col, value: each distinct location with the one place it stands for.

    * The first phrase that can be a city is the city. Of its readings those win whose state another
      phrase of the location names, then those whose country one names, then the larger weight, then
      the smaller country, state and name. Null weights count as the least.
    * ``City, ST`` where the reading has a state, else ``City, Country``.
    * Without a city, the first state, as ``State, Country``, unless the location has a placeholder.
    * All else is Unknown: no place, placeholders, a country alone, null and blank texts.

    Case, punctuation and repeated rows of either table don't count; an empty gazetteer knows no
    place. Other columns of the inputs aren't returned and may have any names.
    """
    own = locations.select(F.col(text_col).alias("text")).distinct()
    book = gazetteer.select("phrase", "kind", "name", "state", "country", "weight")
    spans = phrase_spans(own.select("text", F.col("text").alias("words")), book.select("phrase").distinct(), "text", "words").select(F.col("id").alias("text"), "at", "phrase")
    readings = book.withColumn("phrase", F.array_join(words_of(F.col("phrase")), " ")).distinct()
    met = spans.join(readings, "phrase").select("text", "at", "kind", "name", "state", "country", "weight")

    # a location names a handful of states and countries
    said = lambda kind, col: F.collect_set(F.when(F.col("kind") == kind, F.struct("at", F.col(col).alias("what"))))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    context = met.groupBy("text").agg(said("state", "state").alias("states"), said("country", "country").alias("countries"), first("city").alias("city_at"), first("state").alias("state_at"), F.max((F.col("kind") == "placeholder").cast("int")).alias("held"))
    elsewhere = lambda named, what: F.exists(named, lambda x: (x["at"] != F.col("at")) & (x["what"] == F.col(what))).cast("int")
    cities = met.where("kind = 'city'").join(context, "text").where("at = city_at")
    least = F.lit(float("-inf"))
    best = F.min_by(F.struct("name", "state", "country"), F.struct(-F.coalesce(elsewhere("states", "state"), F.lit(0)), -F.coalesce(elsewhere("countries", "country"), F.lit(0)), -F.coalesce("weight", least), "country", "state", "name"))
    cities = cities.groupBy("text").agg(best.alias("x")).select("text", F.concat_ws(", ", "x.name", F.coalesce("x.state", "x.country")).alias("value"))
    states = met.where("kind = 'state'").join(context.where("city_at is null and held = 0"), "text").where("at = state_at")
    states = states.groupBy("text").agg(F.min(F.struct("country", "name")).alias("x")).select("text", F.concat_ws(", ", "x.name", "x.country").alias("value"))
    found = cities.unionByName(states)
    return own.join(found, "text", "left").select(F.col("text").alias(text_col), F.coalesce("value", F.lit(UNKNOWN)).alias("value"))

