"""The driver's tables as the bronze layer of a job market.

An order is a posting, its customer's name the company, the customer's nation the location, the
brand of its first part the title, its priority the seniority. Parts ordered are the skills asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.functions.text import clean_key

#: Raw seniority labels by order priority, and what the map says about them.
SENIORITIES = {"1-URGENT": "Director", "2-HIGH": "Senior level", "3-MEDIUM": "Mid Level", "5-LOW": "Entry level", "4-NOT SPECIFIED": "Not Applicable"}
SENIORITY_MAP = {"director": "executive", "senior level": "senior", "mid level": "mid", "entry level": "junior"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bronze.job_postings_raw."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    first = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    titled = first.join(parts, "p_partkey")
    # by order last: rows of one order stay together
    rows = orders.join(people, orders.o_custkey == people.c_custkey).join(nations, people.c_nationkey == nations.n_nationkey).join(titled, orders.o_orderkey == titled.l_orderkey, "left")
    key, brand = F.col("o_orderkey"), F.col("p_brand")
    noisy = F.when(key % 3 == 1, F.concat(F.lit("  "), F.upper(F.replace(brand, F.lit("#"), F.lit("   "))))).when(key % 3 == 2, F.concat(F.lower(F.replace(brand, F.lit("#"), F.lit(" "))), F.lit(" "))).otherwise(F.replace(brand, F.lit("#"), F.lit(" ")))
    label = reduce(lambda c, kv: c.when(F.col("o_orderpriority") == kv[0], kv[1]), list(SENIORITIES.items())[1:], F.when(F.col("o_orderpriority") == "1-URGENT", SENIORITIES["1-URGENT"]))
    return rows.select(
        key.alias("job_posting_raw_id"),
        F.floor(key / 10).cast("long").alias("scrape_run_id"),
        key.alias("job_id"),
        F.concat(F.lit("https://jobs.example.com/view/"), F.lower(F.replace(brand, F.lit("#"), F.lit("-"))), F.lit("-"), key.cast("string"), F.lit("?position="), (key % 25).cast("string"), F.lit("&pageNum=0&refId=x")).alias("source_url"),
        noisy.alias("title_raw"),
        F.col("c_name").alias("company_raw"),
        F.when(key % 97 == 0, "   ").otherwise(F.col("n_name")).alias("location_raw"),
        label.alias("seniority_level_raw"),
        F.col("o_orderstatus").alias("employment_type_raw"),
        F.lit(None).cast("string").alias("job_function_raw"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "  ").otherwise(F.col("c_mktsegment")).alias("industry_raw"),
        F.lit(None).cast("string").alias("description_raw"),
        F.col("o_orderdate").alias("scraped_at"),
    )


def _number(name: Column) -> Column:
    return F.regexp_extract(name, "([0-9]+)$", 1).cast("int")


def title_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some titles are held out, one is mapped to unknown."""
    names = read(spark, sf_dir, "part").select("p_brand").distinct()
    n = _number(F.col("p_brand"))
    value = F.when(n == 23, "unknown").otherwise(F.concat(F.lit("role "), (n % 5).cast("string")))
    return names.where(n < 24).select(clean_key(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" "))).alias("key_normalized"), value.alias("value_normalized"), F.lit("llm").alias("method"))


def location_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "nation").select("n_name").distinct()
    n = _number(F.col("n_name"))
    value = F.when(n == 23, "unknown").otherwise(F.concat(F.lit("area "), (n % 8).cast("string")))
    return names.where(n != 24).select(clean_key(F.col("n_name")).alias("key_normalized"), value.alias("value_normalized"), F.lit("fuzzy").alias("method"))


def seniority_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labels, and titles for postings whose label doesn't apply."""
    own = spark.createDataFrame([(False, k, v) for k, v in SENIORITY_MAP.items()], "use_title_key boolean, source_key string, value_normalized string")
    names = read(spark, sf_dir, "part").select("p_brand").distinct()
    n = _number(F.col("p_brand"))
    titles = names.where(n % 3 != 0).select(F.lit(True).alias("use_title_key"), clean_key(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" "))).alias("source_key"), F.when(n % 2 == 0, "mid").otherwise("not_applicable").alias("value_normalized"))
    return own.unionByName(titles).withColumn("method", F.lit("llm"))


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bronze.staging_ready_job_postings: what earlier runs of the cascade let through."""
    from vocatio.operators.cascade import readiness

    p = postings(spark, sf_dir)
    return readiness(p, title_map(spark, sf_dir), location_map(spark, sf_dir), seniority_map(spark, sf_dir)).select("scrape_run_id", "job_posting_raw_id")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posting and skill name, once each."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_posting_raw_id"), F.col("l_partkey").alias("p_partkey"))
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("skill_name"))
    return items.join(parts, "p_partkey").select("job_posting_raw_id", "skill_name").distinct()
