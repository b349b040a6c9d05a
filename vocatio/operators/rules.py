"""The deterministic resolver of all three domains: rules and tables, no model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatio.operators.places import locations_by_rules
from vocatio.operators.resolvers import by_rules
from vocatio.operators.titles import titles_by_rules


def by_tables(keys: DataFrame, rules: DataFrame, occupations: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(domain, use_title_key, key) with ``value`` in lower case: titles by rewriting rules and
    occupations, locations by a gazetteer, seniorities by their words. Keys of other domains are left
    out. Fits ``cascade.run`` as its resolver."""
    none = F.lit(None).cast("boolean").alias("use_title_key")
    own = lambda domain: keys.where(F.col("domain") == domain).select("key")
    titles = titles_by_rules(own("title"), rules, occupations, "key").select(F.lit("title").alias("domain"), none, "key", F.lower("value").alias("value"))
    locations = locations_by_rules(own("location"), gazetteer, "key").select(F.lit("location").alias("domain"), none, "key", F.lower("value").alias("value"))
    seniorities = by_rules(keys.where("domain = 'seniority'")).select("domain", "use_title_key", "key", "value")
    return titles.unionByName(locations).unionByName(seniorities)
