"""Demand views over the facts. Each is a lazy DataFrame, so always live."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 20


def _asked(facts: DataFrame, bridge: DataFrame, skills: DataFrame) -> DataFrame:
    return facts.join(bridge, "job_posting_raw_id").join(skills, "skill_id")


def _reach(*kinds: str) -> list:
    return [F.count("*").alias("job_posting_count"), *[F.countDistinct(f"{k}_id").alias(f"{k}_count") for k in kinds]]


def top_skills(facts: DataFrame, bridge: DataFrame, skills: DataFrame) -> DataFrame:
    return _asked(facts, bridge, skills).groupBy("skill_name").agg(*_reach("company", "title", "location")).orderBy(F.desc("job_posting_count"), "skill_name")


def skills_by_role(facts: DataFrame, bridge: DataFrame, skills: DataFrame) -> DataFrame:
    return _asked(facts, bridge, skills).groupBy("title_normalized", "seniority", "skill_name").agg(*_reach("company"))


def top_skills_by_industry(facts: DataFrame, bridge: DataFrame, skills: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` most asked for skills of each industry; a blank or missing industry is Unknown."""
    industry = F.coalesce(F.nullif(F.trim("industry"), F.lit("")), F.lit("Unknown"))
    demand = _asked(facts, bridge, skills).groupBy(industry.alias("industry"), "skill_name").agg(*_reach("company", "title", "location"))
    rank = F.dense_rank().over(Window.partitionBy("industry").orderBy(F.desc("job_posting_count"), "skill_name"))
    ranked = demand.withColumn("skill_rank", rank).where(F.col("skill_rank") <= top)
    return ranked.select("industry", "skill_rank", "skill_name", "job_posting_count", "company_count", "title_count", "location_count").orderBy("industry", "skill_rank", "skill_name")


def company_hiring_demand(facts: DataFrame) -> DataFrame:
    return facts.groupBy("company").agg(
        F.count("*").alias("job_posting_count"), F.countDistinct("title_id").alias("distinct_roles"), F.countDistinct("location_id").alias("distinct_locations"),
        F.countDistinct("seniority").alias("distinct_seniority_levels"), F.min("scraped_at").alias("first_seen_at"), F.max("scraped_at").alias("last_seen_at"),
    ).orderBy(F.desc("job_posting_count"), "company")


def location_demand(facts: DataFrame) -> DataFrame:
    return facts.groupBy("location").agg(*_reach("company", "title")).orderBy(F.desc("job_posting_count"), "location")


def job_market_summary(facts: DataFrame) -> DataFrame:
    keys = ["title_normalized", "location", "seniority", "employment_type", "industry"]
    return facts.groupBy(*keys).agg(*_reach("company"), F.min("scraped_at").alias("first_seen_at"), F.max("scraped_at").alias("last_seen_at"))
